"""Document-type schemas: rules as data, read on the driver and compiled to Column expressions (SRC13)."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER = Path(__file__).resolve().parents[2] / "config" / "schemas"
HEADING_TYPES = ("section", "heading", "chapter", "article", "named_section")


@dataclass(frozen=True)
class Schema:
    document_type: str
    boundaries: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    extractors: dict = field(default_factory=dict)
    decomposition: dict = field(default_factory=dict)
    links: list = field(default_factory=list)
    limits: dict = field(default_factory=dict)

    def limit(self, name: str) -> int:
        return self.limits.get(name, {"first_min": 1500, "first_max": 3000, "second_min": 500, "second_max": 1500}[name])

    def markers(self) -> list[tuple[str, str]]:
        """(type, pattern) of headings, in the order in which they are tried."""
        return [(b["type"], m) for b in self.boundaries if b["type"] in HEADING_TYPES for m in b.get("markers", [])]


def read(path: Path) -> Schema:
    import yaml

    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    known = {k: v for k, v in raw.items() if k in Schema.__dataclass_fields__}
    return Schema(**known)


@cache
def schemas(folder: str | None = None) -> dict[str, Schema]:
    """All schemas of a folder by document type. A bad file is told of and left out."""
    out = {}
    for path in sorted(Path(folder or FOLDER).glob("*.yaml")):
        try:
            s = read(path)
            out[s.document_type] = s
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).warning("schema %s: %s", path.name, e)
    return out


def schema(document_type: str, folder: str | None = None) -> Schema:
    """JOIN15. Raises ValueError for a type without schema."""
    found = schemas(folder)
    if document_type not in found:
        raise ValueError(f"no schema for document type {document_type!r}; there are {sorted(found)}")
    return found[document_type]


def reload() -> None:
    schemas.cache_clear()


def validate(raw: dict) -> list[str]:
    """What is wrong with a schema's content; empty: nothing."""
    wrong = [] if raw.get("document_type") else ["document_type is missing"]
    wrong += [f"unknown key {k}" for k in raw if k not in Schema.__dataclass_fields__]
    return wrong + [f"boundary {i} has no type" for i, b in enumerate(raw.get("boundaries", [])) if "type" not in b]


def relations(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """Schemas as small tables (a few rows a document type)."""
    b, f, x, d, r, n = [], [], [], [], [], []
    for t, s in schemas(folder).items():
        b += [(t, i, j, y["type"], m) for i, y in enumerate(s.boundaries) for j, m in enumerate(y.get("markers", []))]
        f += [(t, i, name) for i, name in enumerate(s.fields)]
        x += [(t, name, kind, [str(v) for v in ([values] if isinstance(values, str) else values)], bool(c.get("extract_all"))) for name, c in s.extractors.items() for kind, values in c.items() if kind in ("pattern", "patterns", "keywords", "vocabulary")]
        d += [(t, kind, i, y["type"], y.get("group_by"), y.get("extract"), y.get("patterns", [])) for kind, ys in s.decomposition.items() for i, y in enumerate(ys)]
        r += [(t, i, y["name"], y["pattern"], y["type"], y["description"]) for i, y in enumerate(s.links)]
        n += [(t, *(s.limit(k) for k in ("first_min", "first_max", "second_min", "second_max")))]
    return {
        "schema_boundaries": spark.createDataFrame(b, "document_type string, boundary_ord int, marker_ord int, type string, pattern string"),
        "schema_fields": spark.createDataFrame(f, "document_type string, ord int, field string"),
        "schema_extractors": spark.createDataFrame(x, "document_type string, field string, kind string, values array<string>, extract_all boolean"),
        "schema_decomposition": spark.createDataFrame(d, "document_type string, chunk_type string, rule_ord int, rule_type string, group_by string, extract string, patterns array<string>"),
        "schema_rel_patterns": spark.createDataFrame(r, "document_type string, ord int, name string, pattern string, type string, description string"),
        "schema_limits": spark.createDataFrame(n, "document_type string, l1_min int, l1_max int, l2_min int, l2_max int"),
    }
