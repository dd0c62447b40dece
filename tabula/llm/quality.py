"""Host-level quality rules.

Per document: word count, characters in words, symbols, repeated lines and the
words inside repeated 5-word windows.  The base rules (too short, too much
repetition) reject a document by themselves.  The soft rules (symbols, repeated
lines, odd word lengths) are aggregated by host; each host's failure rate is
shrunk towards an empirical beta prior, and a host whose shrunk rate reaches
``HOST_RATE`` is marked for that rule.  The prior has the moments of a
beta-binomial over hosts of n documents each: mean m, and correlation rho of two
documents of one host, estimated from the n-weighted variance of the rates less
the part that sampling alone gives (which is most of it where hosts are small).
It weighs (1 - rho) / rho documents: all of it at rho = 0, where hosts don't
differ and every rate shrinks to m, nothing at rho = 1.  The
host verdicts are joined back: a document is also rejected if it fails a soft
rule for which its host is marked.  A document that fails no rule is kept,
whatever its host.

Edge cases: a null text has no words and fails the base rules; a null host is a
host of its own; repeated rows are measured and returned one by one; an empty
table gives an empty result; one host only gives a prior at that host's rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import fresh, hinted, stored

MIN_WORDS = 10
REPEAT_PCT = 20
WINDOW = 5
SYMBOL_PCT = 10        # symbols per 100 words
DUP_LINE_PCT = 30      # repeated lines per 100 lines that have a word
WORD_LEN = (2.5, 15.0)  # mean characters per word
HOST_RATE = 0.5

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SOFT = ["symbols", "dup_lines", "word_len"]


def repeat_words(ws: list[bytes], width: int = WINDOW) -> int:
    """Words covered by ``width``-word windows that occur twice or more (exact, sort based)."""
    n = len(ws) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    key = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    if len(ids) == len(ws):
        return 0
    size, span = len(ids), 1
    while span < width:  # windows of span + step words, renumbered before a product could overflow
        if size * size >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        step = min(span, width - span)
        key = key[:len(key) - step] * size + key[step:]
        size, span = size * size, span + step
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ws) + 1, np.int64)
    start = np.flatnonzero(again)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(b: bytes | None) -> tuple[int, int, int, int, int, int]:
    b = b or b""
    ws = b.split()  # ASCII white space only
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
    return (len(ws), len(b.translate(None, _NOT_CHARS)), len(b) - len(b.translate(None, _SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeat_words(ws))


def _measure(texts: pa.Array) -> pa.Array:
    rows = np.array([measure_text(b) for b in texts.to_pylist()], np.int64).reshape(-1, 6)
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], [c.split()[0] for c in MEASURES.split(", ")])


def measured(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``out``: the measures and one flag per rule."""
    # declared nondeterministic only so that the optimizer neither repeats it nor pushes it below a join
    m = F.arrow_udf(_measure, MEASURES).asNondeterministic()(F.col(text).cast("binary"))
    tmp, = fresh(docs, f"{out}_m")
    d = docs.withColumn(tmp, m)
    c = {n.split()[0]: F.col(f"{tmp}.{n.split()[0]}") for n in MEASURES.split(", ")}
    mean = c["word_chars"] / F.greatest(c["n_words"], F.lit(1))
    return d.withColumn(out, F.struct(
        *[v.alias(k) for k, v in c.items()],
        ((c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * REPEAT_PCT)).alias("base_failed"),
        (c["n_symbols"] * 100 > c["n_words"] * SYMBOL_PCT).alias("symbols"),
        (c["n_dup_lines"] * 100 > c["n_lines"] * DUP_LINE_PCT).alias("dup_lines"),
        ((c["n_words"] > 0) & ~mean.between(*WORD_LEN)).alias("word_len"))).drop(tmp)


def beta_binomial(hosts: int, n: int, nn: float, x: int, xx: float) -> tuple[float, float]:
    """(m, rho) from the number of hosts and the sums of n, n², failures x and x²/n over the hosts.

    With weights n / N the variance of the rates is m (1 - m) ((1 - rho) a + rho b) in expectation,
    a = (hosts - 1) / N and b = 1 - sum of n² / N²."""
    m = x / n if n else 0.0
    if not 0 < m < 1:
        return m, 0.0
    a, b = (hosts - 1) / n, 1 - nn / n / n
    if b <= a:
        return m, 0.0
    return m, min(1.0, max(0.0, ((xx / n - m * m) / (m * (1 - m)) - a) / (b - a)))


def marked_hosts(scored: DataFrame, host: str, rules: str) -> DataFrame:
    """(host, one flag per soft rule) of the hosts that are marked for at least one rule."""
    per = stored(scored.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"{rules}.{r}").cast("long")).alias(r) for r in SOFT]), "host_rules")
    stats = per.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
                    *[F.sum(r).alias(f"x_{r}") for r in SOFT], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"xx_{r}") for r in SOFT]).first()
    out = per
    for r in SOFT:
        m, rho = beta_binomial(stats["hosts"], stats["n"] or 0, stats["nn"] or 0.0, stats[f"x_{r}"] or 0, stats[f"xx_{r}"] or 0.0)
        rate = (F.col(r) * rho + m * (1 - rho)) / (F.col("n") * rho + (1 - rho))
        out = out.withColumn(r, (F.col(r) > 0) & (rate >= HOST_RATE))
    return out.where(" or ".join(SOFT)).select("host", *SOFT)


def judged(docs: DataFrame, out: str, scored: DataFrame | None = None, host: str = "source") -> DataFrame:
    """``docs`` plus the struct ``out`` (measures, flags, ``kept``).

    ``scored``: rows whose measures are already stored; otherwise the texts are measured twice, once
    for the host rates and once for the verdict, so that no text is ever shuffled or rewritten."""
    d = docs if scored is None else scored
    r, hs = fresh(d, out, f"{out}_host")
    full = measured(d, r) if scored is None else d.withColumnRenamed("rules", r)
    hosts = stored(marked_hosts(full, host, r), "marked_hosts").select(
        F.col("host").alias(hs), F.struct(*SOFT).alias(f"{hs}_f"))
    j = full.join(hinted(hosts), F.col(host).eqNullSafe(F.col(hs)), "left")
    bad = F.lit(False)
    for s in SOFT:
        bad = bad | (F.col(f"{r}.{s}") & F.coalesce(F.col(f"{hs}_f.{s}"), F.lit(False)))
    return j.withColumn(r, F.col(r).withField("kept", ~F.col(f"{r}.base_failed") & ~bad)).drop(hs, f"{hs}_f")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    r, = fresh(docs, "quality")
    return judged(docs, r, host=host).where(F.col(f"{r}.kept")).select(*docs.columns)


def report(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures and verdict per document; the narrow measures are stored, so texts are read once."""
    narrow = docs.select(F.col("doc_id"), F.col(host).alias("source"), F.col("text"))
    scored = stored(measured(narrow, "rules").drop("text"), "quality_measures")
    return judged(narrow, "quality", scored).select(
        "doc_id", *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                     "base_failed", "kept")])
