"""Redaction and the data-quality report."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.operators.aggregates import null_profile
from onledger.plans import ledger, quality, redaction

C = F.col

_RULES = ((n, p.replace("(?i)", "").replace("'", "''"), r, "gi" if p.startswith("(?i)") else "g") for n, p, r in redaction.PATTERNS)


def _steps(source: str, column: str) -> str:
    """The same replacements in DuckDB, one CTE per rule."""
    out, last = [], source
    for i, (name, pattern, repl, flags) in enumerate(RULES):
        ci = "(?i)" if "i" in flags else ""
        out.append(f" r{i} AS (SELECT * EXCLUDE (x), regexp_replace(x, '{pattern}', '{repl}', '{flags}') AS x,"
                   f" len(regexp_extract_all(x, '{ci}{pattern}')) AS {name} FROM {last})")
        last = f"r{i}"
    return f" {source} AS (SELECT *, {column} AS x FROM base)," .replace("SELECT *,", "SELECT id, y,") + ",".join(out)


RULES = tuple(_RULES)
COUNTS = ", ".join(n for n, *_ in RULES)


def _check(base: str) -> str:
    return f"""WITH base AS ({base}),{_steps('r', 'y')}
 SELECT id, md5(x) AS digest, CAST(length(x) AS BIGINT) AS chars, {COUNTS}, x IS DISTINCT FROM y AS changed FROM r{len(RULES) - 1}"""


def _shape(redacted, text):
    return redacted.select("id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars"),
                           *[C(f"redactions.{n}").alias(n) for n, *_ in RULES], "changed")


@query("pip_40_redact_documents", _check("SELECT doc_id AS id, text AS y FROM documents"))
def redact_documents(t):
    return _shape(redaction.redact(t.spread().documents.select(C("doc_id").alias("id"), "text"), ["text"]), "text")


@query("pip_40_redact_pages", _check("SELECT page_id AS id, url || ' ' || html AS y FROM pages"))
def redact_pages(t):
    rows = t.spread().pages.select(C("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("html"))
    return _shape(redaction.redact(rows, ["html"]), "html")


@query("pip_40_redact_json_fields", """
 WITH b AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
 SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END) + count(CASE WHEN id % 3 = 0 THEN 1 END) AS BIGINT) AS credential_fields,
   CAST(count(CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 1 END) AS BIGINT) AS rows_changed, CAST(sum(k) AS BIGINT) AS kept FROM b""")
def redact_json_fields(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.when(C("event_id") % 2 == 0, F.to_json(F.struct(k.alias("k"), F.lit("a\"b").alias("api_key"), F.struct(
        F.lit(7).alias("password")).alias("inner")))).otherwise(F.to_json(F.struct(k.alias("k"))))
    rows = t.events.select(C("event_id").alias("id"), doc.alias("doc"), F.when(C("event_id") % 3 == 0, "open sesame").alias("secret"))
    clean = redaction.redact(rows, ["doc", "secret"])
    return clean.agg(F.count("*").alias("rows"), F.sum("redactions.credential_fields").alias("credential_fields"),
                     F.count_if("changed").alias("rows_changed"), F.sum(F.get_json_object("doc", "$.k").cast("bigint")).alias("kept"))


@query("pip_41_quality_report", """
 SELECT 'status' AS section, 'samples.' || status AS name, CAST(count(*) AS BIGINT) AS value FROM samples GROUP BY status
 UNION ALL SELECT 'nulls', 'samples.return_bp', count(*) - count(return_bp) FROM samples
 UNION ALL SELECT 'nulls', 'assessments.liquidity', count(*) - count(liquidity) FROM assessments
 UNION ALL SELECT 'nulls', 'assessments.observed_at', count(*) - count(observed_at) FROM assessments
 UNION ALL SELECT 'first', 'swaps', min(ts) FROM swap_keys UNION ALL SELECT 'last', 'swaps', max(ts) FROM swap_keys
 UNION ALL SELECT 'first', 'quotes', min(ts) FROM quotes UNION ALL SELECT 'last', 'quotes', max(ts) FROM quotes
 UNION ALL SELECT 'orphans', 'quote_user', count(*) FROM quotes WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT 'orphans', 'swap_transaction', count(*) FROM swap_keys WHERE tx NOT IN (SELECT tx FROM txs)
 UNION ALL SELECT 'rows', 'samples', count(*) FROM samples UNION ALL SELECT 'rows', 'quotes', count(*) FROM quotes""")
def quality_report(t):
    return quality.report(
        statuses=[("samples", t.samples, "status")],
        nulls=[null_profile(t.samples, "samples", ["return_bp"]),
               null_profile(t.assessments, "assessments", ["liquidity", "observed_at"])],
        ranges=quality.time_ranges([("swaps", t.swap_keys, "ts"), ("quotes", t.quotes, "ts")]),
        orphans=ledger.orphans({"quote_user": (t.quotes, "user_id", t.supplier, "s_suppkey"),
                                "swap_transaction": (t.swap_keys, "tx", t.txs, "tx")}),
        tables=[("samples", t.samples), ("quotes", t.quotes)])
