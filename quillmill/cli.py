"""Command line: run, extract, chunk, redact, ingest-psv, ingest-shapes."""

from __future__ import annotations

import argparse
import logging
import sys
import uuid

from pyspark.sql import functions as F

from quillmill import config as C
from quillmill.operators import chunking, pii
from quillmill.plans.extraction import extract
from quillmill.session import get_session, ship
from quillmill.sources import sinks, tabular


def run(spark, cfg: C.Config, **backends) -> dict[str, str]:
    """Extract what is new, clean, chunk, write; the stages' order follows the point at which personal data is cleaned."""
    out = cfg.paths.output_root.rstrip("/")
    progress = sinks.Progress(spark, f"{cfg.paths.checkpoint_dir.rstrip('/')}/progress")
    batch = uuid.uuid4().hex
    docs = extract(spark, cfg.paths.input_root, done=progress, cfg=cfg.detection, **backends).persist()
    if cfg.pii.enabled and cfg.pii.pipeline_point == "post_extraction":
        docs = pii.clean(docs, out_col="text", entities=tuple(cfg.pii.entities), threshold=cfg.pii.context_similarity_threshold)
    sinks.write_documents(docs, f"{out}/documents.parquet", batch)
    if cfg.chunking.enabled:
        done = docs.filter("status = 'completed'")
        chunks = chunking.chunk_documents(done, cfg.chunking.chunk_size, overlap=cfg.chunking.overlap, tables_col="tables" if cfg.chunking.chunk_tables else None)
        if cfg.pii.enabled and cfg.pii.pipeline_point == "post_chunk":
            chunks = pii.clean(chunks, out_col="text", entities=tuple(cfg.pii.entities), threshold=cfg.pii.context_similarity_threshold)
        sinks.write_table(chunks, f"{out}/chunks.parquet", sinks.CHUNKS, mode="append")
    progress.update(docs.groupBy("source_path").agg(F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("completed").alias("status")), batch)
    return {"documents": f"{out}/documents.parquet", "chunks": f"{out}/chunks.parquet", "batch": batch}


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="quillmill")
    p.add_argument("--verbose", "-v", default=False, action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, names in {"run": ["config"], "extract": ["input", "output"], "chunk": ["input", "output"], "redact": ["input", "output"], "ingest-psv": ["input", "output"], "ingest-shapes": ["input", "output"]}.items():
        s = sub.add_parser(verb)
        for n in names:
            s.add_argument(f"--{n}", required=True)
        if verb == "extract":
            s.add_argument("--limit", type=int)
            s.add_argument("--skip", type=int, default=0)
            s.add_argument("--format", choices=["parquet", "txt"], default="parquet")
        if verb == "chunk":
            s.add_argument("--size", type=int, default=480)
            s.add_argument("--overlap", type=float, default=0)
        if verb == "ingest-psv":
            s.add_argument("--md5", action="store_true")
        if verb == "redact":
            s.add_argument("--mode", choices=["flag", "blackout", "delete"], default="flag")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    spark = get_session()
    ship(spark)
    if a.verb == "run":
        run(spark, C.load(a.config))
    elif a.verb == "extract":
        docs = extract(spark, a.input, a.limit, a.skip)
        if a.format == "txt":
            ids = [r[0] for r in docs.filter("status = 'completed'").select("document_id").limit(2).collect()]
            if len(ids) != 1:
                print("text output needs exactly one document", file=sys.stderr)
                return 1
            sinks.write_text(docs, ids[0], a.output)
        else:
            sinks.write_documents(docs, a.output)
    elif a.verb == "chunk":
        sinks.write_table(chunking.chunk_documents(sinks.read_documents(spark, a.input), a.size, overlap=a.overlap), a.output, sinks.CHUNKS)
    elif a.verb == "redact":
        from quillmill.operators import redaction

        reports = redaction.redaction_reports(spark.read.parquet(a.input)).persist()
        logging.info("documents with redactions: %d", redaction.redacted_documents(reports).first()[0])
        reports.select("document_id", "total", "affected_pages", redaction.redaction_warnings(F.col("report")).alias("warnings")).write.mode("overwrite").parquet(a.output)
    elif a.verb == "ingest-psv":
        return 0 if tabular.ingest_psv_directory(spark, a.input, a.output, a.md5) else 1
    else:
        from quillmill.sources.geo import ingest_shape_directory

        return 1 if any(r["error"] for r in ingest_shape_directory(spark, a.input, a.output)) else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
