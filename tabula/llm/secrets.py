"""Secret scan with corpus-wide ownership frequency.

Base kinds (assignments, access keys, hex runs) are found by pattern; a further
kind, ``token`` (long runs that mix lower case, upper case and digits outside
any base span), is only a candidate.  Every candidate's value is hashed and the
distinct repositories and owners that hold it are counted over the whole corpus:
a value that ``EXAMPLE_OWNERS`` or more owners hold, or ``EXAMPLE_REPOS`` or more
repositories (one owner's template among them), is a copied example; one that
fewer hold and that looks random is live.  Live tokens become spans; redaction
replaces live spans only.

The texts are read once: a match leaves the lengths of itself and of the gap
before it, in characters and in bytes, and the hash of its value.  Positions are
running sums over a text's matches, overlaps and merged cuts are running extremes
over its spans, and redaction cuts the text's bytes at the spans' byte offsets, so
the work follows the number of matches, also in a text full of them.

Copies of one secret in one repository collapse before the shuffle (partial
aggregation), so a value in a third of all documents costs a row per task.

In these tables ``source`` is the owner and (source, lang) the repository.

Edge cases: null text is empty; null owners or repositories count as one; a
text of secrets only, very long texts and repeated rows are handled whole;
spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm.common import fresh, hinted, let, stored
from tabula.operators.ranking import null_safe_join

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run shorter than 16 holds no other run, so none is hidden
TOKEN = r"[A-Za-z0-9_-]{20,}"
MIN_VALUE, MIN_ACCESS = 12, 18
EXAMPLE_OWNERS, EXAMPLE_REPOS = 4, 8
MARK = "[REDACTED]"
MIN_DISTINCT = 6  # different characters of a value that looks live
_MATCH = "array<struct<kind:int,place:int,gap:int,gap_bytes:int,size:int,bytes:int,value:string,fits:boolean,random:boolean>>"
_TEXT = ["doc_id", "h"]


def _matches(text: Column, kind: int, pattern: str, group: int, fits) -> Column:
    """The leftmost non-overlapping matches in order; ``split`` gives the gaps and ``regexp_extract_all`` the matches."""
    rx = F.lit(pattern)
    looks = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT) & ~F.lower(v).contains("example")

    def facts(x: Column) -> Column:
        return F.transform(x["m"], lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.length(x["g"][i]).alias("gap"), F.octet_length(x["g"][i]).alias("gap_bytes"),
            F.length(m).alias("size"), F.octet_length(m).alias("bytes"), F.when(fits(m, x["v"][i]), F.sha2(x["v"][i], 256)).alias("value"),
            fits(m, x["v"][i]).alias("fits"), F.when(fits(m, x["v"][i]), looks(x["v"][i])).alias("random")))

    return let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, rx, F.lit(0)).alias("m"),
                        F.regexp_extract_all(text, rx, F.lit(group)).alias("v")), facts)


def matches(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Stored narrow rows: doc_id, h, owner, repo and ``found``, the matches of all kinds."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_MATCH)
    low, named = F.lower(text), F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | low.contains(word)
    found = F.concat(
        F.when(named, _matches(text, 0, ASSIGN, 2, lambda m, v: F.length(v) >= MIN_VALUE)).otherwise(none),
        F.when(text.contains("AKIA"), _matches(text, 1, ACCESS, 0, lambda m, v: F.length(m) >= MIN_ACCESS)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, 2, HEX, 0, lambda m, v: F.lit(True))).otherwise(none),
        F.when(text.rlike(TOKEN), _matches(text, 3, TOKEN, 0, lambda m, v: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"))).otherwise(none))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return stored(docs.select("doc_id", F.xxhash64("text").alias("h"), name(owner).alias("owner"),
                              F.concat_ws("\u0001", *[name(c) for c in repo]).alias("repo"), found.alias("found")), "secret_matches")


def spans(found: DataFrame) -> DataFrame:
    """Stored rows doc_id, h, kind, start, end, start_byte, end_byte, value, random: the base spans of each different
    text and the tokens that no base span overlaps."""
    texts = found.where(F.size("found") > 0).groupBy(*_TEXT).agg(F.first("found").alias("found"))
    each = texts.select(*_TEXT, F.explode("found").alias("m")).select(*_TEXT, "m.*")
    until = Window.partitionBy(*_TEXT, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at = each.select("*", F.sum(F.col("gap") + F.col("size")).over(until).alias("end"), F.sum(F.col("gap_bytes") + F.col("bytes")).over(until).alias("end_byte"))
    at = at.where("fits").select(*_TEXT, "kind", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                                 (F.col("end_byte") - F.col("bytes")).alias("start_byte"), "end_byte", "value", "random")
    own = Window.partitionBy(*_TEXT)
    before = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(own.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return stored(at.select("*", (free | (F.col("kind") < 3)).alias("taken")).where("taken").drop("taken"), "secret_spans")


def ownership(found: DataFrame, at: DataFrame) -> DataFrame:
    """(value, owners, repos): distinct owners and repositories of each candidate value."""
    holders = found.where(F.size("found") > 0).select(*_TEXT, "owner", "repo").distinct()
    per_repo = null_safe_join(at.select(*_TEXT, "value").distinct(), holders, _TEXT).select("value", "owner", "repo").distinct()
    per_owner = per_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def verdicts(found: DataFrame) -> DataFrame:
    """The spans with ``owners``, ``repos`` and ``live``."""
    at = spans(found)
    freq = stored(ownership(found, at), "secret_owners")
    live = F.col("random") & (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repos") < EXAMPLE_REPOS)
    return at.join(hinted(freq), "value").withColumn("live", live)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied (spans whose value is a copied example)
    for every document row."""
    found = matches(docs, **columns)
    v = verdicts(found)
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    per = v.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"),
                                F.count_if(copied).alias("n_copied"))
    rows = null_safe_join(found.select(*_TEXT), per, _TEXT, "left")
    every = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    base = F.filter(every, lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter(every, lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(_joined(base), 256).alias("base_sha256"),
                       _joined(F.filter(every, lambda x: (x["kind"] < 3) | x["live"])).alias("spans"),
                       F.size(F.filter(every, lambda x: x["live"])).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def redact(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` with every live span replaced by ``[REDACTED]``; overlapping spans give one mark."""
    did, h, cuts = fresh(docs, "secret_id", "text_hash", "secret_cuts")
    live = verdicts(matches(docs, **columns)).where("live").select(*_TEXT, "start", "start_byte", "end", "end_byte")
    order = Window.partitionBy(*_TEXT).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = live.select("*", F.when(F.col("start") < reach, 0).otherwise(1).alias("new"))
    cut = parted.select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cut"))
    merged = cut.groupBy(*_TEXT, "cut").agg(F.min("start_byte").alias("start"), F.max("end_byte").alias("end"))
    v = merged.groupBy(F.col("doc_id").alias(did), F.col("h").alias(h)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    v = stored(v, "secret_cuts")
    j = docs.join(v, docs["doc_id"].eqNullSafe(F.col(did)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")

    def cut_out(x: Column) -> Column:
        end = lambda i: F.coalesce(F.get(x["c"], i)["end"], F.lit(0)).cast("int")
        part = lambda lo, hi: F.substring(x["b"], lo + 1, hi - lo).cast("string")
        kept = F.transform(x["c"], lambda c, i: part(end(i - 1), c["start"].cast("int")))
        return F.concat(F.array_join(kept, MARK), F.lit(MARK), part(end(F.size(x["c"]) - 1), F.octet_length(x["b"])))

    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(let(F.struct(F.col("text").cast("binary").alias("b"), F.col(cuts).alias("c")), cut_out))
    return j.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
