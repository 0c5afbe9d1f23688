"""Removal of credentials and addresses from text, with counts of what was removed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions.pin import pinned

CREDENTIAL, URL = "[REDACTED_CREDENTIAL]", "[REDACTED_URL]"

# --- fixed values: what counts as a credential ------------------------------------------------------------------------
SECRET_NAME = (r"(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth(?:orization)?|password|passwd|secret|private[_-]?key|mnemonic"
               r"|seed[_-]?phrase|cookie|client[_-]?secret|credential(?:s)?)")
PATTERNS = (
    ("urls", r"(?i)\b(?:https?|wss?)://[^\s<>\"'\\]+", URL),
    ("bearer_tokens", r"(?i)\bBearer\s+[A-Za-z0-9_.~+/=-]+", CREDENTIAL),
    ("api_tokens", r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{16,}\b", CREDENTIAL),
    ("credential_assignments",
     r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|private[_-]?key|client[_-]?secret)\s*[:=]\s*[^\s,;]+", CREDENTIAL),
)
_JSON_FIELD = r'(?i)("' + SECRET_NAME + r'"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|\[[^\[\]{}]*\]|\{[^{}]*\})'

#: A credential name, also inside JSON held as text, whose value still stands: nested too deep for the pattern above.
_LEFT = r'(?i)\\*"' + SECRET_NAME + r'\\*"\s*+:\s*+(?!\\*"\[REDACTED_CREDENTIAL\])'


def _within_json(pattern: str) -> str:
    """A text rule for use in JSON: a value ends at a quote or backslash, so that the document stays valid."""
    return pattern.replace(r"[^\s,;]+", r'[^\s,;"\\]+')


def redact(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Redact text columns in place; adds ``redactions`` (counts by rule) and ``changed``.

    Columns with a credential name are replaced whole. In JSON text the values of credential-named keys go first; where such a
    value is nested deeper, or stands in JSON held as text, the whole document is replaced. Then addresses, bearer tokens, API
    tokens and assignments are replaced, each rule on the result of the one before; JSON stays valid.
    """
    counts: dict[str, Column] = {"credential_fields": F.lit(0), **{name: F.lit(0) for name, _, _ in PATTERNS}}
    out = rows
    before = {c: F.col(c) for c in columns}
    for c in columns:
        text = F.col(c)
        if re.fullmatch(SECRET_NAME, c, re.IGNORECASE):
            counts["credential_fields"] = counts["credential_fields"] + F.when(text.isNotNull(), 1).otherwise(0)
            out = out.withColumn(f"_new_{c}", F.when(text.isNotNull(), CREDENTIAL))
            continue
        is_json = F.ltrim(text).rlike(r"\A[\{\[]") & F.try_parse_json(text).isNotNull()
        counts["credential_fields"] = counts["credential_fields"] + F.coalesce(
            F.when(is_json, F.regexp_count(text, F.lit(_JSON_FIELD))), F.lit(0))
        json, stage = f"_j_{c}", f"_s_{c}"
        out = pinned(out, json, F.coalesce(is_json, F.lit(False)))
        out = pinned(out, stage, F.when(F.col(json), F.regexp_replace(text, _JSON_FIELD, f'$1"{CREDENTIAL}"')).otherwise(text))
        left = F.coalesce(F.col(json) & F.col(stage).rlike(_LEFT), F.lit(False))
        counts["credential_fields"] = counts["credential_fields"] + F.when(left, 1).otherwise(0)
        out = pinned(out, f"_t_{c}", F.when(left, f'"{CREDENTIAL}"').otherwise(F.col(stage)))
        stage = f"_t_{c}"
        for i, (name, pattern, replacement) in enumerate(PATTERNS):
            here, nxt = F.col(stage), f"_s{i}_{c}"
            inner = _within_json(pattern)
            seen, cleaned = F.regexp_count(here, F.lit(pattern)), F.regexp_replace(here, pattern, replacement)
            if inner != pattern:
                seen = F.when(F.col(json), F.regexp_count(here, F.lit(inner))).otherwise(seen)
                cleaned = F.when(F.col(json), F.regexp_replace(here, inner, replacement)).otherwise(cleaned)
            counts[name] = counts[name] + F.coalesce(seen, F.lit(0))
            out = pinned(out, nxt, cleaned)
            stage = nxt
        out = out.withColumn(f"_new_{c}", F.col(stage))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~before[c].eqNullSafe(F.col(f"_new_{c}"))
    found = F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()])
    named = {c: F.col(f"_new_{c}") for c in columns}
    return out.withColumns({"redactions": found, "changed": changed}).select(
        *[named[c].alias(c) if c in named else F.col(c) for c in rows.columns], "redactions", "changed")


def redaction_report(redacted: DataFrame) -> DataFrame:
    """Totals by rule and the number of rows changed."""
    names = redacted.schema["redactions"].dataType.names
    return redacted.agg(*[F.sum(f"redactions.{n}").alias(n) for n in names], F.count_if("changed").alias("rows_changed"),
                        F.count("*").alias("rows"))
