"""CSV and pipe-separated tables, all strings, nothing turned into nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

SCHEMA_VERSION = "2024.11"
_OF_CODES = r"(?i)^authority_code_(.+?_aut)_psv$"
_OF_STATE = r"(?i)^([a-z]{2}[a-z]?)_(.+)_psv$"
_CODES = """ADDRESS_ALIAS_TYPE ADDRESS_CHANGE_TYPE ADDRESS_TYPE FLAT_TYPE GEOCODED_LEVEL_TYPE GEOCODE_RELIABILITY GEOCODE_TYPE LEVEL_TYPE
LOCALITY_ALIAS_TYPE LOCALITY_CLASS MB_MATCH_CODE PS_JOIN_TYPE STREET_CLASS STREET_LOCALITY_ALIAS_TYPE STREET_SUFFIX STREET_TYPE"""
# "@" stands for the two dates of a record's life, "<x>" for x with its prefix and suffix, a leading "=" for the table's own id
_TABLES = """
ADDRESS_ALIAS: = @ principal_pid alias_pid alias_type_code alias_comment
ADDRESS_DEFAULT_GEOCODE: = @ address_detail_pid geocode_type_code longitude latitude
ADDRESS_DETAIL: = date_created date_last_modified date_retired building_name <lot_number> flat_type_code <flat_number> level_type_code <level_number> <number_first> <number_last> street_locality_pid location_description locality_pid alias_principal postcode private_street legal_parcel_id confidence address_site_pid level_geocoded_code property_pid gnaf_property_pid primary_secondary
ADDRESS_FEATURE: address_feature_id = address_detail_pid date_address_detail_created date_address_detail_retired address_change_type_code
ADDRESS_MESH_BLOCK_2016: = @ address_detail_pid mb_match_code mb_2016_pid
ADDRESS_MESH_BLOCK_2021: = @ address_detail_pid mb_match_code mb_2021_pid
ADDRESS_SITE: = @ address_type address_site_name
ADDRESS_SITE_GEOCODE: = @ address_site_pid geocode_site_name geocode_site_description geocode_type_code reliability_code boundary_extent planimetric_accuracy elevation longitude latitude
LOCALITY: = @ locality_name primary_postcode locality_class_code state_pid gnaf_locality_pid gnaf_reliability_code
LOCALITY_ALIAS: = @ locality_pid name postcode alias_type_code state_pid
LOCALITY_NEIGHBOUR: = @ locality_pid neighbour_locality_pid
LOCALITY_POINT: = @ locality_pid planimetric_accuracy longitude latitude
MB_2016: = @ mb_2016_code
MB_2021: = @ mb_2021_code
PRIMARY_SECONDARY: = primary_pid secondary_pid @ ps_join_type_code ps_join_comment
STATE: = @ state_name state_abbreviation
STREET_LOCALITY: = @ street_class_code street_name street_type_code street_suffix_code locality_pid gnaf_street_pid gnaf_street_confidence gnaf_reliability_code
STREET_LOCALITY_ALIAS: = @ street_locality_pid street_name street_type_code street_suffix_code alias_type_code
STREET_LOCALITY_POINT: = @ street_locality_pid boundary_extent planimetric_accuracy longitude latitude
"""


def _tables() -> dict[str, list[str]]:
    out = {f"{name}_AUT": ["code", "name", "description"] for name in _CODES.split()}
    for line in _TABLES.strip().splitlines():
        name, words = line.split(":")
        cols: list[str] = []
        for w in words.split():
            if w == "=":
                cols.append(f"{name.lower()}_pid")
            elif w == "@":
                cols += ["date_created", "date_retired"]
            elif w.startswith("<"):
                cols += [f"{w[1:-1]}_prefix", w[1:-1], f"{w[1:-1]}_suffix"]
            else:
                cols.append(w)
        out[name] = cols
    return out


ADDRESS_TABLES = _tables()


def parse_psv_name(stem: Column) -> Column:
    """struct<state, table>: authority code files first, then those of a state; nulls where neither fits."""
    aut = F.regexp_extract(stem, _OF_CODES, 1)
    state = F.regexp_extract(stem, _OF_STATE, 1)
    table = F.regexp_extract(stem, _OF_STATE, 2)
    is_aut, is_state = aut != "", table != ""
    return F.struct(F.when(~is_aut & is_state, F.upper(state)).alias("state"), F.when(is_aut, F.upper(aut)).when(is_state, F.upper(table)).alias("table"))


def psv_name(stem: str) -> tuple:
    """The same for one name on the driver."""
    if m := re.match(_OF_CODES, stem):
        return None, m[1].upper()
    if m := re.match(_OF_STATE, stem):
        return m[1].upper(), m[2].upper()
    return None, None


def _no_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def read_psv(spark: SparkSession, path: str, table: str | None = None) -> DataFrame | None:
    """A headerless pipe-separated file with its table's columns; None where the table isn't known. A row of another width fails the read."""
    stem = re.sub(r"\.[^.]+$", "", path.rstrip("/").rsplit("/", 1)[-1])
    table = table or psv_name(stem)[1]
    if table not in ADDRESS_TABLES:
        return None
    schema = StructType([StructField(c, StringType()) for c in ADDRESS_TABLES[table]])
    return _no_nulls(spark.read.schema(schema).option("sep", "|").option("mode", "FAILFAST").csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file, quotes doubled, every cell a string."""
    return _no_nulls(spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').option("inferSchema", "false").csv(path))


def with_provenance(df: DataFrame, **facts: str) -> DataFrame:
    """The facts as metadata of every column, which Parquet keeps with Spark's schema."""
    meta = {k: str(v) for k, v in facts.items() if v is not None}
    return df.select(*[F.col(c).alias(c, metadata=meta) for c in df.columns])


def ingest_psv(spark: SparkSession, path: str, out: str, md5: bool = False) -> dict | None:
    """Write one file as Parquet with its provenance; None where its name, table or content is no good."""
    from quillmill.sources.files import md5_of_files

    name = path.rstrip("/").rsplit("/", 1)[-1]
    state, table = psv_name(re.sub(r"\.[^.]+$", "", name))
    df = read_psv(spark, path, table) if table else None
    if df is None:
        return None
    try:
        digest = md5_of_files(spark, path).first()["md5"] if md5 else None
        with_provenance(df, schema_version=SCHEMA_VERSION, table_name=table, source_file=name, state=state, source_md5=digest).write.mode("overwrite").parquet(out)
    except Exception as error:  # Spark wraps a malformed row in several ways
        if "MALFORMED" in str(error) or "FAILFAST" in str(error):
            return None
        raise
    return {"table": table, "state": state, "rows": spark.read.parquet(out).count(), "md5": digest, "path": out}


def ingest_psv_directory(spark: SparkSession, root: str, out: str, md5: bool = False) -> list[dict]:
    """All pipe-separated files below ``root``, one output each. The list of files is what the driver loops over."""
    from quillmill.sources.files import discover_recursive

    done = []
    for r in discover_recursive(spark, root, "psv").collect():
        stem = re.sub(r"\.[^.]+$", "", r["path"].rsplit("/", 1)[-1])
        if one := ingest_psv(spark, r["path"], f"{out.rstrip('/')}/{stem}.parquet", md5):
            done.append(one)
    return done
