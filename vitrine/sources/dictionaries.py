"""Signature and vendor dictionaries: small YAML configuration, checked once on the driver.

A dictionary is configuration, not data: it is read whole, validated, and then compiled into column
expressions by the matching operators, so no join and no broadcast is involved. `as_rows` exposes the
same entries as a DataFrame for totals and audits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED = Path(__file__).resolve().parent.parent / "dictionaries"

# The capability taxonomy and the confidence levels.
CAPABILITIES = (
    "b2b_wholesale",
    "multistore_sync",
    "launch_scheduling",
    "discount_logic",
    "sso_login",
    "international_markets",
    "checkout_customization",
    "staff_permissions",
)
CONFIDENCE = ("high", "medium", "low")
SHARED_ASSET_HOST = "cdn.shopify.com"

PATTERN_KINDS = ("script_host", "script_src", "dom_marker")


class DictionaryError(ValueError):
    """A dictionary entry breaks one of its rules."""


@dataclass(frozen=True)
class Signature:
    key: str
    capability: str | None = None
    confidence: str = "low"
    verified: bool = False
    script_host: tuple[str, ...] = ()
    script_src: tuple[str, ...] = ()
    dom_marker: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReviewVendor:
    vendor: str
    detect: tuple[str, ...] = ()
    count: tuple[str, ...] = ()
    endpoint: str | None = None
    verified: bool = False


@dataclass(frozen=True)
class Dictionaries:
    apps: list[Signature] = field(default_factory=list)
    fingerprints: list[Signature] = field(default_factory=list)
    vendors: list[ReviewVendor] = field(default_factory=list)


def _entries(path: str | Path) -> list[dict]:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    if not isinstance(raw, list):
        raise DictionaryError(f"{path}: expected a list of entries")
    return raw


def check_signatures(entries: list[Signature], need_capability: bool) -> list[Signature]:
    """Refuse unknown capabilities and confidences, and host patterns that hit the shared asset host."""
    for e in entries:
        if e.confidence not in CONFIDENCE:
            raise DictionaryError(f"{e.key}: confidence {e.confidence!r} is not one of {CONFIDENCE}")
        if need_capability and e.capability not in CAPABILITIES:
            raise DictionaryError(f"{e.key}: capability {e.capability!r} is not in the taxonomy")
        for pattern in e.script_host:
            if re.search(pattern, SHARED_ASSET_HOST, re.IGNORECASE):
                raise DictionaryError(f"{e.key}: host pattern {pattern!r} matches {SHARED_ASSET_HOST}, shared by all apps")
    return entries


# The descriptive fields an entry may carry besides its key, capability and patterns.
_DESCRIPTIVE = {
    "display_name",
    "vendor",
    "plus_native_equivalent",
    "plus_native_evidence_url",
    "app_evidence_url",
    "evidence_url",
    "plus_compatible",
    "used_on_plus_commonly",
    "notes",
}


def _signatures(path: str | Path, need_capability: bool) -> list[Signature]:
    """Entries name their key `key`, `app_key` or `fingerprint_key`; patterns sit flat or under `patterns`."""
    out = []
    for raw in _entries(path):
        fields = {k: v for k, v in raw.items() if k not in _DESCRIPTIVE}
        fields.update(fields.pop("patterns", None) or {})
        key = fields.pop("key", None) or fields.pop("app_key", None) or fields.pop("fingerprint_key", None)
        unknown = set(fields) - set(Signature.__dataclass_fields__)
        if unknown or not key:
            raise DictionaryError(f"{path}: entry {key!r} has unknown fields {sorted(unknown)} or no key")
        out.append(Signature(key, **{k: tuple(v) if k in PATTERN_KINDS else v for k, v in fields.items()}))
    return check_signatures(out, need_capability)


def load_apps(path: str | Path = SHIPPED / "app_signatures.yaml") -> list[Signature]:
    return _signatures(path, need_capability=True)


def load_fingerprints(path: str | Path = SHIPPED / "plan_fingerprints.yaml") -> list[Signature]:
    return _signatures(path, need_capability=False)


def load_vendors(path: str | Path = SHIPPED / "review_vendors.yaml") -> list[ReviewVendor]:
    return [
        ReviewVendor(
            vendor=raw["vendor"],
            detect=tuple(raw.get("detect") or raw.get("detect_patterns") or ()),
            count=tuple(raw.get("count") or raw.get("count_regexes") or ()),
            endpoint=raw.get("endpoint") or raw.get("endpoint_url_regex"),
            verified=bool(raw.get("verified", False)),
        )
        for raw in _entries(path)
    ]


def load_all() -> Dictionaries:
    return Dictionaries(load_apps(), load_fingerprints(), load_vendors())


def as_rows(spark: SparkSession, name: str, entries: list[Signature]) -> DataFrame:
    """One row per pattern: (dict, key, entry_ord, capability, kind, pattern_ord, pattern, verified)."""
    rows = [
        (name, e.key, i, e.capability, kind, j, pattern, e.verified)
        for i, e in enumerate(entries)
        for kind in PATTERN_KINDS
        for j, pattern in enumerate(getattr(e, kind))
    ]
    return spark.createDataFrame(
        rows,
        "dict string, key string, entry_ord int, capability string, kind string, pattern_ord int, pattern string, verified boolean",
    )


def entry_rows(spark: SparkSession, name: str, entries: list[Signature]) -> DataFrame:
    """One row per entry, with or without patterns."""
    return spark.createDataFrame(
        [(name, e.key, e.capability, e.verified) for e in entries],
        "dict string, key string, capability string, verified boolean",
    )


def config_hash(paths: list[str | Path]) -> str:
    """SHA-256 over the contents of the configuration files, in the order given; recorded with every scan."""
    import hashlib

    digest = hashlib.sha256()
    for path in paths:
        digest.update(Path(path).read_bytes())
    return digest.hexdigest()


SHIPPED_FILES = [SHIPPED / n for n in ("app_signatures.yaml", "plan_fingerprints.yaml", "review_vendors.yaml")]
