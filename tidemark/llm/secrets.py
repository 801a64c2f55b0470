"""Secret scans over every version of every file, with a ledger of contents that were scanned before.

A version (a path and its text) is addressed by the SHA-256 of the text, its blob. Only pairs of blob and rule
version that the ledger lacks are scanned, each blob once however many paths hold it; findings go into the ledger
and are joined back to all paths. Only DataFrame functions are used.

Positions come from the regular expression's own cuts: splitting at the matches gives the lengths between them and
a running sum over both gives the starts. The sum is a window over exploded matches, so a text with very many
matches stays linear.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than `least` are dropped.

    `hint`: a text without any of these strings cannot match; empty for no such test.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: tuple[str, ...] = ()
    version: int = 1


#: Fixed by the contract of op3; their order breaks ties between spans that start together.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),  # a greedy run matches whole, so this equals dropping shorter runs
)
#: Published token formats with fixed prefixes.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", hint=("PRIVATE KEY-----",)),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}", hint=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat_token", r"xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}", hint=("xox",)),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", hint=("AIza",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=(".eyJ",)),
)
RULES = BASE_RULES + MORE_RULES


def _kind_order(rules: tuple[Rule, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind")).cast("int")


def _found(text: str, rule: Rule) -> Column:
    """For each match: its kind, place in the sequence, length of the text before it, own length, and if it counts."""
    t, pattern = F.col(text), F.lit(rule.pattern)
    parts, whole = F.split(t, rule.pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0))
    judged = F.regexp_extract_all(t, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.zip_with(
        F.arrays_zip(parts.alias("p"), whole.alias("m")),
        judged,
        lambda x, g: F.struct(
            F.lit(rule.kind).alias("kind"), F.char_length(x["p"]).cast("bigint").alias("before"), F.char_length(x["m"]).cast("bigint").alias("long"),
            (F.char_length(g) >= rule.least).alias("counts"),
        ),
    )
    rows = F.transform(F.filter(rows, lambda x: x["long"].isNotNull()), lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["before"].alias("before"), x["long"].alias("long"), x["counts"].alias("counts")))
    hinted = reduce(lambda a, b: a | b, (t.contains(h) for h in rule.hint), F.lit(not rule.hint))
    test = F.array_contains("todo", rule.kind) & hinted & t.rlike(rule.pattern)
    return F.when(test, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,before:bigint,long:bigint,counts:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans (blob, kind, start, end), end exclusive, in code points. `blobs`: blob, text, todo (kinds to look for)."""
    hits = blobs.select("blob", F.explode(F.flatten(F.array(*(_found("text", r) for r in rules)))).alias("h")).select("blob", "h.*").distinct()  # repeated rows give equal hits
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("before") + F.col("long")).over(so_far))
    return hits.where("counts").select("blob", "kind", (F.col("end") - F.col("long")).alias("start"), "end")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, *, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(versions with their blob, the ledger brought up to date).

    `versions` keeps its columns except the text and gains `blob`; a null text counts as empty. The ledger has one
    row per blob and rule version, with an empty list where nothing was found, so nothing is scanned twice. Repeated
    rows share one blob; an empty table leaves the ledger as it was.
    """
    others = [c for c in versions.columns if c != text_col]
    addressed = versions.select(F.col(f"`{path_col}`").alias("_path"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), text_of(f"`{text_col}`").alias("text"))
    addressed = addressed.withColumn("blob", F.sha2("text", 256))
    known = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    blobs = addressed.groupBy("blob").agg(F.min("_path").alias("_path"))
    pairs = blobs.select("blob", "_path", F.explode(known).alias("k")).select("blob", "_path", "k.*")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    pairs = written(pairs, "secrets-unseen")
    todo = pairs.groupBy("blob").agg(F.min("_path").alias("_at"), F.collect_set("kind").alias("todo"))
    texts = addressed.select("_path", "blob", "text").join(todo, (addressed["blob"] == todo["blob"]) & addressed["_path"].eqNullSafe(todo["_at"])).select(addressed["blob"], "text", "todo")
    spans = scan_blobs(texts, rules)
    spans = spans.groupBy("blob", "kind").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    fresh = pairs.join(spans, ["blob", "kind"], "left").select("blob", "kind", "version", F.coalesce("spans", none).alias("spans"))
    fresh = written(fresh, "secrets-ledger")
    return addressed.select("_row", "blob"), fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, and all its spans under the current rule versions as an array of (start, order, kind, end), sorted."""
    current = reduce(lambda a, b: a | b, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules))
    rows = ledger.where(current & (F.size("spans") > 0)).select("blob", "kind", _kind_order(rules).alias("order"), F.explode("spans").alias("s"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start"), F.col("order"), F.col("kind"), F.col("s.end")))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets_query(docs: DataFrame) -> DataFrame:
    versions, ledger = scan_versions(docs.select("doc_id", "text"), path_col="doc_id")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    rows = versions.join(findings_by_blob(ledger), "blob", "left").select("_row.doc_id", F.coalesce("spans", none).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("s", lambda x: x["order"] <= len(BASE_RULES))
    return rows.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every span found in its text replaced by `mark`; overlapping spans make one. Other rows and columns stay,
    whatever their names. A null text stays null and an empty one empty; texts of any length are read whole; repeated rows
    change alike; an empty table gives no rows."""
    versions, ledger = scan_versions(docs.select(f"`{id_col}`", f"`{text_col}`"), path_col=id_col, text_col=text_col, rules=rules)
    del versions
    rows = findings_by_blob(ledger, rules).select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    before = Window.partitionBy("blob").orderBy("start", "end")
    rows = rows.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("blob", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts")).select(F.col("blob").alias("_blob"), "_cuts")
    columns, text = docs.columns, F.col("_text")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), text_of(f"`{text_col}`").alias("_text"))
    joined = whole.join(cuts, F.sha2(text, 256) == F.col("_blob"), "left")
    last = lambda i: F.when(i > 0, F.get("_cuts", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    pieces = F.transform("_cuts", lambda s, i: F.concat(F.substring(text, (last(i) + 1).cast("int"), (s["start"] - last(i)).cast("int")), F.lit(mark)))
    tail = F.substring(text, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.char_length(text))
    clean = F.when(F.col("_cuts").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*((clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)) for c in columns))


def secrets_sql() -> str:
    """op3 for DuckDB. The patterns are the ones above; both engines' dialects agree on them."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    found = "\n  UNION ALL ".join(
        f"SELECT doc_id, {lit(r.kind)} AS kind, {k + 1} AS ord, {r.least} AS least, string_split_regex(t, {lit(r.pattern)}) AS parts, "
        f"regexp_extract_all(t, {lit(r.pattern)}, 0) AS whole, regexp_extract_all(t, {lit(r.pattern)}, {r.group}) AS judged FROM d WHERE regexp_matches(t, {lit(r.pattern)})"
        for k, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {lit(r.kind)}) AS n_{r.kind}" for r in BASE_RULES)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT doc_id, kind, ord, least, i, length(parts[i]) AS before, length(whole[i]) AS long, length(judged[i]) AS judged FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f)),
p AS (SELECT doc_id, kind, ord, long, judged >= least AS counts, sum(before + long) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM e),
s AS (SELECT doc_id, kind, ord, CAST(e - long AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE counts),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (WHERE ord <= {len(BASE_RULES)}) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
