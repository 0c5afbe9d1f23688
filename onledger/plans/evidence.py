"""Typed evidence: measurements, validation, freshness, findings, and the values that may still be used.

A document is one row with ``ms``: an array with one struct per catalogue entry, always in catalogue order. Rules read plain
columns (``Plain`` says which), so that Spark compiles them; lambdas over the array would be interpreted. They are written as
SQL text, which plans faster than thousands of column calls. Metrics with the same provenance share its columns, and what
follows from it is worked out once for all of them. Arrays are put together for output only. Nothing is shuffled: a document
never leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.bindings import RISK_FLAGS
from onledger.functions.decode import ADDRESS_FORMAT, ATOMIC_FORMAT, HASH_FORMAT, POOL_FORMAT
from onledger.functions.guards import freshness as fresh_state
from onledger.functions.pin import pinned
from onledger.params import MAX_AGE_SECONDS, SOURCE_MAX_AGE_SECONDS

# --- fixed values: measurement catalogue (id, value type, unit, lowest, highest) --------------------------------------
CATALOGUE = (
    ("market.price", "number", "USD/token", 0, None),
    ("market.liquidity", "number", "USD", 0, None),
    ("quote.quantity", "number", "token", 0, None),
    ("quote.usd_in", "number", "USD", 0, None),
    ("simulation.passed", "boolean", "boolean", None, None),
    ("simulation.buy_shortfall", "number", "fraction", 0, 1),
    ("simulation.sell_shortfall", "number", "fraction", 0, 1),
    ("simulation.roundtrip_loss", "number", "fraction", None, 1),
    ("holders.raw_top10", "number", "fraction", 0, 1),
    ("holders.adjusted_top10", "number", "fraction", 0, 1),
    ("buyers.distinct", "integer", "wallets", 0, None),
    ("buyers.qualified", "integer", "wallets", 0, None),
    ("buyers.total", "integer", "transactions", 0, None),
    ("buyers.reviewed", "integer", "transactions", 0, None),
    ("buyers.pending", "integer", "transactions", 0, None),
    ("buyers.ambiguous", "integer", "transactions", 0, None),
    ("buyers.coverage", "number", "fraction", 0, 1),
    ("liquidity.lp_supply", "string", "atomic LP tokens", None, None),
    ("liquidity.lp_burned", "number", "fraction", 0, 1),
    ("source.verified", "boolean", "boolean", None, None),
    *((f"controls.{flag}", "boolean", "risk flag", None, None) for flag in RISK_FLAGS),
)

# --- fixed values: closed vocabularies --------------------------------------------------------------------------------
STATUSES = ("measured", "partial", "missing", "error", "undefined", "not_applicable")
UNAVAILABLE = ("missing", "error", "undefined", "not_applicable")
ACTIONS = ("none", "refresh_market", "refresh_holders", "complete_buyers", "refresh_source", "refresh_permissions")
SEVERITIES = ("info", "warning", "blocker")
CODES = ("STALE_QUOTE", "STALE_HOLDERS", "STALE_PERMISSIONS", "MISSING_PROVENANCE", "INCOMPLETE_BUYER_HISTORY",
         "UNRESOLVED_HOLDER_CLASSIFICATION", "UNDEFINED_LP_BURN", "MISSING_PERMISSIONS", "SOURCE_NOT_VERIFIED",
         "BLOCK_MISMATCH", "SCHEMA_INVALID", "SIMULATION_SCOPE", "SELLABILITY_PROVIDER_UNKNOWN", "MISSING_QUOTE",
         "LIQUIDITY_LOCK_UNRESOLVED")
BUYER_SOURCE = "receipt_and_call_trace"
RISK_PROVIDER = "goplus"

METRICS = tuple(row[0] for row in CATALOGUE)
CONTROLS = tuple(f"controls.{flag}" for flag in RISK_FLAGS[3:])
_INDEX = {name: i for i, name in enumerate(METRICS)}
_SPEC = {row[0]: row for row in CATALOGUE}


# --- fixed values: what can be wrong with one measurement, with a document, and between measurements -------------------
RULES = ("invalid status", "unavailable value must be null", "measured value required", "invalid value type", "out of range",
         "invalid atomic amount", "missing scope", "wrong unit", "invalid observation time", "invalid block number",
         "block hash requires block number", "invalid block hash", "measured value requires provenance",
         "non-measured status requires a reason")
HEAD_RULES = ("Invalid token", "Invalid pool", "Invalid assessment timestamp", "Invalid measurement catalogue")
CROSS_RULES = ("buyers: inconsistent coverage counts", "buyers: zero denominator must be undefined",
               "buyers: incorrect coverage fraction", "buyers: incomplete counts must be partial",
               "liquidity: zero LP supply must have undefined burn fraction",
               "holders: adjusted concentration requires classification evidence")

_KINDS = {"number": "DOUBLE", "flag": "BOOLEAN", "observed_at": "DOUBLE", "block_number": "BIGINT"}
_NAMES = "CAST(array() AS ARRAY<STRING>)"
_FINDINGS = "CAST(array() AS ARRAY<STRUCT<code: STRING, evidence_ids: ARRAY<STRING>, follow_up: STRING, severity: STRING>>)"


class Plain(NamedTuple):
    """The columns that hold the fields of one measurement; None where a field is NULL in every document."""

    number: str | None = None
    flag: str | None = None
    text: str | None = None
    status: str | None = None
    reason: str | None = None
    source: str | None = None
    observed_at: str | None = None
    block_number: str | None = None
    block_hash: str | None = None
    unit: str | None = None
    scope: str | None = None

    def sql(self, field: str) -> str:
        return getattr(self, field) or f"CAST(NULL AS {_KINDS.get(field, 'STRING')})"

    @property
    def valued(self) -> str:
        return _any(f"{x} IS NOT NULL" for x in self[:3] if x)

    @property
    def unsourced(self) -> str:
        return f"(coalesce({self.sql('source')}, '') = '')"

    @property
    def provenance(self) -> tuple:
        return self.observed_at, self.block_number, self.block_hash


Document = dict[str, Plain]


def at(ms: Column, metric: str) -> Column:
    return F.get(ms, F.lit(_INDEX[metric]))


def _any(conditions: Iterable[str]) -> str:
    return f"({' OR '.join(conditions) or 'false'})"


def _texts(values: Iterable[str]) -> str:
    return f"array({', '.join(_quoted(x) for x in values)})"


def _quoted(text: str) -> str:
    return f"r'{text}'"


def _bits(broken: dict[int, str]) -> str:
    """One bit per rule that is known to be broken."""
    return " | ".join(f"CASE WHEN {bad} THEN {1 << rule} ELSE 0 END" for rule, bad in broken.items())


def _named(rules: Iterable[str], bits: str) -> str:
    return f"filter({_texts(rules)}, (rule, i) -> getbit({bits}, i) = 1)"


def _picked(empty: str, choices: Iterable[tuple[str, str]]) -> str:
    """The values of the choices that hold, in order. Compiled, unlike ``array_compact``, which goes through a lambda."""
    return f"concat({empty}, {', '.join(f'CASE WHEN {when} THEN array({value}) ELSE {empty} END' for when, value in choices)})"


def _with(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def _observe(rows: DataFrame) -> tuple[DataFrame, Document]:
    """Flat observations as plain columns, without inventing provenance."""
    rows = _with(rows, {
        "_at_market": "CAST(CASE WHEN market_present THEN coalesce(market_at, observed_at) END AS DOUBLE)",
        "_at_simulation": "CAST(coalesce(sim_at, CASE WHEN sim_status IS NOT NULL AND sim_block = market_block THEN observed_at END) AS DOUBLE)",
        "_at_buyers": "CAST(coalesce(buyer_at, CASE WHEN buyers_present AND buyer_block = market_block THEN observed_at END) AS DOUBLE)",
        "_other": "coalesce(coalesce(pool_version, CASE WHEN startswith(market_source, 'v3_') THEN 3"
                  " WHEN startswith(market_source, 'v4_') THEN 4 WHEN market_source = 'v2_reserves' THEN 2 END) IN (3, 4), false)",
        "_incomplete": "coalesce(buyer_pending > 0 OR buyer_ambiguous > 0, false)"})
    put: dict[str, str] = {}
    doc: Document = {}
    given: dict[str, tuple] = {}

    def held(name: str, field: str, value: str) -> str:
        put[name] = f"CAST({value} AS {_KINDS.get(field, 'STRING')})"
        return name

    def family(name: str, observed: str | None = None, **fields: str) -> dict[str, str | None]:
        return {"observed_at": observed, **{field: held(f"_{field}_{name}", field, value) for field, value in fields.items()}}

    market = family("market", "_at_market", source="market_source", block_number="market_block", block_hash="market_hash")
    quote = family("quote", "_at_market", source="quote_source", block_number="quote_block") | {"block_hash": market["block_hash"]}
    sim = family("simulation", "_at_simulation", source="sim_source", block_number="sim_block")
    holders = family("holders", source="holder_source", observed_at="holder_at", block_number="holder_block")
    buyers = family("buyers", "_at_buyers", source=f"CASE WHEN buyers_present THEN '{BUYER_SOURCE}' END", block_number="buyer_block")
    explorer = family("source", source="source_provider", observed_at="source_at")
    controls = family("controls", source=f"'{RISK_PROVIDER}'", observed_at="risk_checked_at")
    scopes: dict[str, str] = {}

    def measure(metric: str, provenance: dict, scope: str, status: str | None = None, reason: str | None = None, **values: str) -> None:
        """What was observed; ``status`` and ``reason`` only where they do not follow from the rest."""
        i = _INDEX[metric]
        scope = scopes.setdefault(scope, f"_scope_{i}")
        doc[metric] = Plain(**{field: held(f"_{field}_{i}", field, value) for field, value in values.items()}, **provenance,
                            status=f"_status_{i}", reason=f"_reason_{i}", unit=held(f"_unit_{i}", "unit", _quoted(_SPEC[metric][2])),
                            scope=scope)
        given[metric] = status, reason

    for name in ("price", "liquidity"):
        measure(f"market.{name}", market, "'selected pool'", number=name)
    for name in ("quantity", "usd_in"):
        measure(f"quote.{name}", quote, "'size-specific pool quote'", reason="quote_error",
                number=f"CASE WHEN quote_status = 'quoted' THEN quote_{name} END")
    account = "concat('account=unknown; input=', coalesce(CAST(quote_usd_in AS STRING), 'unknown'), ' USD; one block only')"
    measure("simulation.passed", sim, account, status="CASE WHEN sim_status = 'failed' THEN 'error' END", reason="sim_error",
            flag="CASE WHEN sim_status = 'passed' THEN true END")
    for name in ("buy_shortfall", "sell_shortfall", "roundtrip_loss"):
        measure(f"simulation.{name}", sim, account, number=f"CASE WHEN sim_status = 'passed' THEN {name} END")
    measure("holders.raw_top10", holders, "'raw addresses; includes pool and custody balances'", number="top10_share")
    measure("holders.adjusted_top10", {}, "'requires documented address classification and denominator'",
            reason="'address_classification_unresolved'")
    for name, col in (("distinct", "distinct_buyers"), ("qualified", "qualified_buys")):
        measure(f"buyers.{name}", buyers, "'verified lower bound in indexed pools, last 300 seconds'", number=col,
                status=f"CASE WHEN _incomplete AND {col} IS NOT NULL THEN 'partial' END",
                reason="CASE WHEN _incomplete THEN 'pending_or_ambiguous_transactions' END")
    for name in ("total", "reviewed", "pending", "ambiguous"):
        measure(f"buyers.{name}", buyers, "'indexed pools, last 300 seconds'", number=f"buyer_{name}")
    measure("buyers.coverage", buyers, "'reviewed / observed transactions'",
            status="CASE WHEN buyer_total = 0 THEN 'undefined' END", reason="CASE WHEN buyer_total = 0 THEN 'no_observed_transactions' END",
            number="CASE WHEN buyer_total <> 0 THEN try_divide(buyer_reviewed, buyer_total) END")
    zero = "(NOT _other AND coalesce(lp_supply = '0', false))"
    measure("liquidity.lp_supply", market, "'V2 LP total supply'", status="CASE WHEN _other THEN 'not_applicable' END",
            reason="CASE WHEN _other THEN 'not_a_v2_pool' END", text="CASE WHEN NOT _other THEN lp_supply END")
    measure("liquidity.lp_burned", market, "'burned V2 LP / issued V2 LP; not a time-lock proof'",
            status=f"CASE WHEN _other THEN 'not_applicable' WHEN {zero} THEN 'undefined' END",
            reason=f"CASE WHEN _other THEN 'not_a_v2_pool' WHEN {zero} THEN 'zero_lp_supply' END",
            number=f"CASE WHEN NOT _other AND NOT {zero} THEN lp_burned END")
    measure("source.verified", explorer, "'published source match; does not establish permission safety'",
            flag="CASE WHEN source_status = 'verified' THEN true WHEN source_status = 'unverified' THEN false END")
    for flag in RISK_FLAGS:
        measure(f"controls.{flag}", controls, "'provider risk flag; False=reported absent, True=reported present'",
                flag=f"CASE WHEN {flag} = 'pass' THEN false WHEN {flag} = 'fail' THEN true END")
    for value, name in scopes.items():
        held(name, "scope", value)

    derived: dict[str, str] = {}
    for metric, m in doc.items():
        status, reason = given[metric]
        known = (f"CASE WHEN NOT {m.valued} THEN 'missing' WHEN {m.sql('source')} IS NOT NULL AND {m.sql('observed_at')} IS NOT NULL"
                 " THEN 'measured' ELSE 'partial' END")
        derived[m.status] = known if status is None else f"coalesce({status}, {known})"
    why = {m.reason: (given[metric][1] or "CAST(NULL AS STRING)", m) for metric, m in doc.items()}
    return _with(_with(_with(rows, put), derived), {
        name: f"CASE WHEN {m.status} <> 'measured' THEN coalesce({reason}, CASE WHEN {m.valued} THEN 'provenance_incomplete'"
              f" ELSE 'not_observed' END) ELSE {reason} END" for name, (reason, m) in why.items()}), doc


def _gathered(doc: Document) -> str:
    """The measurements as one array."""
    return "array({})".format(", ".join(f"named_struct('metric_id', '{metric}', {{}})".format(
        ", ".join(f"'{field}', {doc[metric].sql(field)}" for field in Plain._fields)) for metric in METRICS))


def _spread(documents: DataFrame) -> tuple[DataFrame, Document]:
    """The measurements of finished documents as plain columns."""
    doc = {metric: Plain(*[f"_{field}_{i}" for field in Plain._fields]) for i, metric in enumerate(METRICS)}
    return _with(documents, {name: f"get(ms, {_INDEX[metric]}).{field}" for metric, m in doc.items()
                             for field, name in m._asdict().items()}), doc


def build(rows: DataFrame) -> DataFrame:
    """Turn flat observations into documents without inventing provenance."""
    observed, doc = _observe(rows)
    return observed.select(*[x for x in rows.columns if x != "ms"], F.expr(_gathered(doc)).alias("ms"))


def measurements(documents: DataFrame, key: str = "id") -> DataFrame:
    """Long form: one row per document and metric."""
    return documents.select(key, F.inline("ms"))


def _provenance_rules(m: Plain) -> dict[str, str]:
    seen, block, block_hash = m.sql("observed_at"), m.sql("block_number"), m.sql("block_hash")
    return {"invalid observation time": f"isnan({seen}) OR {seen} < 0 OR {seen} = CAST('Infinity' AS DOUBLE)",
            "invalid block number": f"{block} < 0",
            "block hash requires block number": f"{block_hash} IS NOT NULL AND {block} IS NULL",
            "invalid block hash": f"NOT {block_hash} RLIKE {_quoted(HASH_FORMAT)}"}


def _measurement_rules(metric: str, m: Plain) -> dict[str, str]:
    """Rule -> SQL that is true where one measurement breaks it. Rules that the catalogue entry has no use for are left out."""
    _, kind, unit, low, high = _SPEC[metric]
    number, status, text = m.sql("number"), m.sql("status"), m.sql("text")
    finite = f"({number} IS NOT NULL AND NOT isnan({number}) AND abs({number}) <> CAST('Infinity' AS DOUBLE))"
    typed = {"number": finite, "integer": f"({finite} AND {number} = floor({number}))", "boolean": f"({m.sql('flag')} IS NOT NULL)",
             "string": f"({text} IS NOT NULL)"}[kind]
    out = {"invalid status": f"NOT {status} IN {STATUSES}",
           "unavailable value must be null": f"{status} IN {UNAVAILABLE} AND {m.valued}",
           "measured value required": f"{status} IN ('measured', 'partial') AND NOT {m.valued}",
           "invalid value type": f"{m.valued} AND NOT {typed}",
           "missing scope": f"coalesce({m.sql('scope')}, '') = ''",
           "wrong unit": f"{m.sql('unit')} <> {_quoted(unit)}",
           "measured value requires provenance": f"{status} = 'measured' AND ({m.unsourced} OR {m.sql('observed_at')} IS NULL)",
           "non-measured status requires a reason": f"{status} <> 'measured' AND coalesce({m.sql('reason')}, '') = ''"}
    bounds = [f"coalesce({number} {side} {bound}, false)" for side, bound in (("<", low), (">", high)) if bound is not None]
    if bounds:
        out["out of range"] = f"{m.valued} AND {typed} AND {_any(bounds)}"
    if metric == "liquidity.lp_supply":
        out["invalid atomic amount"] = f"{m.valued} AND {typed} AND NOT {text} RLIKE {_quoted(ATOMIC_FORMAT)}"
    return out


def _cross_rules(doc: Document) -> tuple[str, ...]:
    """What measurements say about each other, in the order of ``CROSS_RULES``."""
    total, reviewed, pending, ambiguous, coverage = (
        doc[f"buyers.{k}"].sql("number") for k in ("total", "reviewed", "pending", "ambiguous", "coverage"))
    counted = " AND ".join(f"{x} IS NOT NULL" for x in (total, reviewed, pending, ambiguous))
    status = lambda name: doc[name].sql("status")
    burned, adjusted = doc["liquidity.lp_burned"].sql("number"), doc["holders.adjusted_top10"]
    return (f"{counted} AND ({reviewed} + {pending} <> {total} OR {ambiguous} > {reviewed})",
            f"{counted} AND {total} = 0 AND ({coverage} IS NOT NULL OR {status('buyers.coverage')} <> 'undefined')",
            f"{counted} AND {total} <> 0 AND ({coverage} IS NULL OR abs({coverage} - try_divide({reviewed}, {total})) > 1e-9D)",
            f"{counted} AND ({pending} > 0 OR {ambiguous} > 0) AND ({status('buyers.distinct')} = 'measured'"
            f" OR {status('buyers.qualified')} = 'measured')",
            f"{doc['liquidity.lp_supply'].sql('text')} = '0' AND ({burned} IS NOT NULL OR {status('liquidity.lp_burned')} <> 'undefined')",
            f"{adjusted.sql('number')} IS NOT NULL AND NOT coalesce({adjusted.sql('source')} = 'verified_address_classification', false)")


def _checked(rows: DataFrame, doc: Document, catalogue_ok: str = "true") -> DataFrame:
    """Adds ``errors``. Rules only set bits; most measurements break none, so texts are put together only where one does."""
    number = {rule: i for i, rule in enumerate(RULES)}
    shared = {m.provenance: (f"_loose_{_INDEX[metric]}", m) for metric, m in reversed(doc.items())}
    head = (f"NOT coalesce(token RLIKE {_quoted(ADDRESS_FORMAT)}, false)", f"NOT coalesce(pool RLIKE {_quoted(POOL_FORMAT)}, true)",
            "NOT coalesce(ts >= 0, false)", f"NOT ({catalogue_ok})")
    out = _with(rows, {name: _bits({number[rule]: bad for rule, bad in _provenance_rules(m).items()}) for name, m in shared.values()})
    bad = ", ".join(f"{_bits({number[rule]: bad for rule, bad in _measurement_rules(metric, doc[metric]).items()})}"
                    f" | {shared[doc[metric].provenance][0]}" for metric in METRICS)
    out = _with(out, {"_head": _bits(dict(enumerate(head))), "_cross": _bits(dict(enumerate(_cross_rules(doc)))),
                      "_bad": f"CASE WHEN {catalogue_ok} THEN array({bad}) ELSE CAST(array() AS ARRAY<INT>) END"})
    single = (f"flatten(transform({_texts(METRICS)}, (metric, k) -> CASE WHEN get(_bad, k) > 0 THEN transform("
              f"{_named(RULES, 'get(_bad, k)')}, rule -> concat(metric, ': ', rule)) ELSE {_NAMES} END))")
    return _with(out, {"errors": f"CASE WHEN _head > 0 OR array_max(_bad) > 0 THEN concat({_named(HEAD_RULES, '_head')}, {single})"
                                 f" WHEN _cross > 0 THEN {_named(CROSS_RULES, '_cross')} ELSE {_NAMES} END"})


def validate(documents: DataFrame) -> DataFrame:
    """Adds ``errors``; rules between measurements are checked only once every single one is sound."""
    kept = [x for x in documents.columns if x != "errors"]
    checked = _checked(*_spread(documents.select(*kept)), f"ms.metric_id = {_texts(METRICS)}")
    return pinned(checked.select(*kept, "errors"), "errors", F.col("errors"))


def _judged(rows: DataFrame, doc: Document, now: str, max_age: int) -> tuple[DataFrame, list[str]]:
    """Adds ``findings`` and a column of freshness per time of observation; returns these columns' names in catalogue order."""
    keys = {metric: (m.observed_at, SOURCE_MAX_AGE_SECONDS if metric == "source.verified" else max_age) for metric, m in doc.items()}
    states = {key: f"_fresh_{_INDEX[metric]}" for metric, key in reversed(keys.items())}
    graded = rows.withColumns({name: fresh_state(F.col(now), F.expr(Plain(observed_at=seen).sql("observed_at")), F.lit(limit))
                               for (seen, limit), name in states.items()})
    fresh = {metric: states[key] for metric, key in keys.items()}
    present = {metric: m.valued for metric, m in doc.items()}
    old = {metric: f"({present[metric]} AND {fresh[metric]} <> 'fresh')" for metric in METRICS}
    unseen = {metric: f"({present[metric]} AND {fresh[metric]} = 'unknown')" for metric in METRICS}
    bare = {metric: f"({present[metric]} AND {m.unsourced})" for metric, m in doc.items()}
    missing = {metric: f"NOT {present[metric]}" for metric in METRICS}
    out: list[tuple[str, str]] = []

    def any_of(names, test: dict) -> str:
        return _any(test[name] for name in names)

    def names_where(names, test: dict) -> str:
        return _picked(_NAMES, [(test[name], f"'{name}'") for name in names])

    def finding(when: str, code: str, evidence, follow_up="none", severity="warning") -> None:
        """``code`` is a code or a CASE of codes, ``evidence`` the metrics or SQL for them."""
        code = code if code.startswith("CASE") else f"'{code}'"
        evidence = evidence if isinstance(evidence, str) else _texts(evidence)
        out.append((when, f"named_struct('code', {code}, 'evidence_ids', {evidence}, 'follow_up', '{follow_up}', 'severity', '{severity}')"))

    for name, code, action in (("quote.quantity", "STALE_QUOTE", "refresh_market"),
                               ("holders.raw_top10", "STALE_HOLDERS", "refresh_holders")):
        stale = f"{fresh[name]} = 'stale'"
        finding(f"{stale} OR {unseen[name]}", f"CASE WHEN {stale} THEN '{code}' ELSE 'MISSING_PROVENANCE' END", [name], action, "blocker")
    finding(missing["quote.quantity"], "MISSING_QUOTE", ["quote.quantity"], "refresh_market", "blocker")
    for prefix, action in (("market.", "refresh_market"), ("simulation.", "refresh_market"), ("buyers.", "complete_buyers")):
        family = [name for name in METRICS if name.startswith(prefix)]
        finding(any_of(family, old), f"CASE WHEN {any_of(family, unseen)} THEN 'MISSING_PROVENANCE' ELSE 'STALE_QUOTE' END",
                names_where(family, old), action, "blocker")
    finding(any_of(METRICS, bare), "MISSING_PROVENANCE", names_where(METRICS, bare), severity="blocker")
    finding(old["liquidity.lp_burned"], "MISSING_PROVENANCE", ["liquidity.lp_burned"], "refresh_market", "blocker")
    finding(any_of(CONTROLS, missing), "MISSING_PERMISSIONS", names_where(CONTROLS, missing), "refresh_permissions", "blocker")
    finding(any_of(CONTROLS, old), "STALE_PERMISSIONS", names_where(CONTROLS, old), "refresh_permissions", "blocker")
    finding(f"NOT (coalesce({doc['source.verified'].sql('flag')}, false) AND {fresh['source.verified']} = 'fresh')",
            "SOURCE_NOT_VERIFIED", ["source.verified"], "refresh_source", "blocker")
    finding(_any(f"coalesce({doc[f'buyers.{k}'].sql('number')}, 0) <> 0" for k in ("pending", "ambiguous")), "INCOMPLETE_BUYER_HISTORY",
            ["buyers.distinct", "buyers.qualified", "buyers.coverage"], "complete_buyers")
    finding(missing["holders.adjusted_top10"], "UNRESOLVED_HOLDER_CLASSIFICATION", ["holders.raw_top10", "holders.adjusted_top10"])
    lp = ["liquidity.lp_supply", "liquidity.lp_burned"]
    finding(f"{doc[lp[1]].sql('status')} = 'undefined'", "UNDEFINED_LP_BURN", lp)
    finding(f"{doc[lp[1]].sql('status')} = 'not_applicable'", "LIQUIDITY_LOCK_UNRESOLVED", lp, severity="blocker")
    elsewhere = {name: f"{doc[name].sql('block_number')} <> {doc['quote.quantity'].sql('block_number')}"
                 for name in ("holders.raw_top10", "simulation.passed", "buyers.distinct")}
    finding(any_of(elsewhere, elsewhere), "BLOCK_MISMATCH", f"concat(array('quote.quantity'), {names_where(elsewhere, elsewhere)})",
            "refresh_holders")
    simulated = doc["simulation.passed"].sql("flag")
    finding(simulated, "SIMULATION_SCOPE", ["simulation.passed"], severity="info")
    finding(f"{simulated} AND {missing['controls.cannot_sell_all']}", "SELLABILITY_PROVIDER_UNKNOWN",
            ["controls.cannot_sell_all", "simulation.passed"], severity="info")
    invalid = f"array(named_struct('code', 'SCHEMA_INVALID', 'evidence_ids', {_NAMES}, 'follow_up', 'none', 'severity', 'blocker'))"
    return _with(graded, {"findings": f"CASE WHEN size(errors) > 0 THEN {invalid} ELSE {_picked(_FINDINGS, out)} END"}), [
        fresh[metric] for metric in METRICS]


def quality(documents: DataFrame, now: str = "now", max_age: int = MAX_AGE_SECONDS) -> DataFrame:
    """Adds ``freshness`` (in catalogue order) and ``findings``; ``documents`` carries ``errors``."""
    kept = [x for x in documents.columns if x not in ("freshness", "findings")]
    judged, _ = _judged(*_spread(documents.select(*kept)), now, max_age)
    limits = lambda m: F.when(m["metric_id"] == "source.verified", SOURCE_MAX_AGE_SECONDS).otherwise(max_age)
    states = F.transform("ms", lambda m: fresh_state(F.col(now), m["observed_at"], limits(m)))
    return pinned(judged.select(*kept, states.alias("freshness"), "findings"), "findings", F.col("findings"))


def assess(rows: DataFrame, now: str = "now", max_age: int = MAX_AGE_SECONDS) -> DataFrame:
    """``build``, ``validate`` and ``quality`` in one go: the measurements stay in plain columns until the end."""
    kept = [x for x in rows.columns if x not in ("ms", "errors", "freshness", "findings")]
    observed, doc = _observe(rows.select(*kept))
    judged, states = _judged(_checked(observed, doc), doc, now, max_age)
    return pinned(judged, "_held", F.struct("errors", "findings")).select(
        *kept, F.expr(_gathered(doc)).alias("ms"), F.col("_held.errors").alias("errors"), F.array(*states).alias("freshness"),
        F.col("_held.findings").alias("findings"))


def effective(graded: DataFrame) -> DataFrame:
    """Values that may be used: everything NULL for an invalid document, stale or unsourced values NULL otherwise."""
    ms = F.col("ms")
    sound = F.size("errors") == 0

    def usable(name: str, field: str) -> Column:
        m = at(ms, name)
        ok = sound & (at(F.col("freshness"), name) == "fresh") & (F.coalesce(m["source"], F.lit("")) != "")
        return F.when(ok, m[field])

    verified = usable("source.verified", "flag")
    simulated = F.coalesce(usable("simulation.passed", "flag"), F.lit(False))
    quantity = usable("quote.quantity", "number")
    flags = {f"eff_{flag}": F.when(sound, F.when(usable(f"controls.{flag}", "flag"), "fail").when(
        ~usable(f"controls.{flag}", "flag"), "pass").otherwise("unknown")) for flag in RISK_FLAGS}
    return graded.withColumns({
        "eff_price": usable("market.price", "number"), "eff_liquidity": usable("market.liquidity", "number"),
        "eff_top10": usable("holders.raw_top10", "number"), "eff_buyers": usable("buyers.distinct", "number"),
        "eff_qualified": usable("buyers.qualified", "number"), "eff_lp_burned": usable("liquidity.lp_burned", "number"),
        "eff_source": F.when(sound, F.when(verified, "verified").when(~verified, "unverified").otherwise("unavailable")),
        "eff_quote": F.when(sound & quantity.isNotNull(), F.col("quote_status")),
        "eff_quantity": quantity, "eff_usd_in": F.when(quantity.isNotNull(), usable("quote.usd_in", "number")),
        "eff_sim": F.when(simulated, F.col("sim_status")), **flags})


def finding_rows(graded: DataFrame, key: str = "id") -> DataFrame:
    """Long form of the findings with their position in the document."""
    return graded.select(key, F.posexplode("findings").alias("ordinal", "f")).select(key, "ordinal", "f.*")


def check_review_findings(reviews: DataFrame, key: str = "id") -> DataFrame:
    """Errors of review findings: only supplied metric ids, known codes, actions and severities, at most 40 findings.

    reviews: key, findings (array of code, evidence_ids, follow_up, severity), supplied (array of metric ids).
    """
    def wrong(f: Column) -> Column:
        return F.array_compact(F.array(
            F.when(~f["code"].isin(*CODES) | ~f["follow_up"].isin(*ACTIONS) | ~f["severity"].isin(*SEVERITIES),
                   "invalid_code_action_or_severity"),
            F.when(F.exists(f["evidence_ids"], lambda m: ~F.array_contains(F.col("supplied"), m)), "evidence_not_supplied")))

    errors = F.flatten(F.transform("findings", wrong))
    errors = F.concat(errors, F.when(F.size("findings") > 40, F.array(F.lit("too_many_findings"))).otherwise(
        F.array().cast("array<string>")))
    return reviews.select(key, F.array_sort(F.array_distinct(errors)).alias("errors"))
