"""Validated configuration, read from YAML."""

from __future__ import annotations

from pydantic import BaseModel, Field

_Share = lambda default: Field(default, ge=0.0, le=1.0)


class Paths(BaseModel):
    input_root: str
    output_root: str
    checkpoint_dir: str = "checkpoints"


class Detection(BaseModel):
    min_text_coverage: float = _Share(0.3)
    table_signal_threshold: float = _Share(0.4)
    form_signal_threshold: float = _Share(0.5)
    max_sample_pages: int = Field(5, ge=1)


class Ocr(BaseModel):
    engine: str = "none"
    lang: str = "eng"
    dpi: int = Field(200, ge=72, le=600)


class Native(BaseModel):
    include_tables: bool = True


class Extraction(BaseModel):
    ocr: Ocr = Ocr()
    native: Native = Native()


class Redaction(BaseModel):
    enabled: bool = True
    mode: str = "flag"
    threshold: int = Field(50, ge=0, le=255)
    min_area_ratio: float = _Share(0.001)
    max_area_ratio: float = _Share(0.9)
    dpi: int = Field(150, ge=72, le=600)


class Pii(BaseModel):
    enabled: bool = False
    entities: list[str] = ["PERSON"]
    person_types: list[str] = ["natural"]
    pipeline_point: str = "post_extraction"
    context_similarity_threshold: float = _Share(0.35)


class Chunking(BaseModel):
    enabled: bool = True
    chunk_size: int = Field(480, ge=1)
    chunk_tables: bool = True
    overlap: float = Field(0, ge=0)


class Enrichment(BaseModel):
    enabled: bool = False
    max_retries: int = Field(3, ge=0)
    retry_base_delay: float = Field(2.0, ge=0.0)
    batch_size: int = Field(10, ge=1)
    skip_short_documents: int = Field(0, ge=0)


class Processing(BaseModel):
    batch_size: int = Field(100, ge=1)
    checkpoint_every: int = Field(100, ge=1)


class Config(BaseModel):
    paths: Paths
    detection: Detection = Detection()
    extraction: Extraction = Extraction()
    redaction: Redaction = Redaction()
    pii: Pii = Pii()
    chunking: Chunking = Chunking()
    enrichment: Enrichment = Enrichment()
    processing: Processing = Processing()


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return Config.model_validate(yaml.safe_load(f))
