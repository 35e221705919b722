"""Secret scans: fixed patterns, and a battery of randomness tests for what they miss.

Tokens of 20 characters or more outside the base spans are candidates. The encoding is
inferred (decimal, hex, base32, base36, base64), each character gets its place in that alphabet,
and three tests are run: chi-squared against a uniform alphabet, the number of runs above
and below the middle of the alphabet, and the lag-1 serial correlation. A token must look
uniform to all three. False discoveries are controlled over the corpus by the
Benjamini-Hochberg rule on the p-value under "ordinary text of this length": there the
chi-squared statistic has a non-centrality that grows with the length, so short tokens
need a clearer case than long ones. How fast it grows is learned for each encoding from
the corpus's own tokens that don't look uniform. The p-values are counted in bins over all
documents; only one number for each encoding and the bin counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm._common import apart, let, materialize, no_spans, numbered, replaced, restored, spans_of

# Fixed values of the base patterns; quantifiers are possessive or anchored where that changes no match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: Symbols by encoding, in the order of their values.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SYMBOLS = {k: float(len(s)) for k, s in ALPHABETS.items()}
#: Chi-squared non-centrality by character of ordinary text written in each alphabet: what is taken before the corpus
#: is seen, with the weight of PRIOR_TOKENS of its tokens.
PRIOR_TOKENS = 100
TEXT_DIVERGENCE = {"decimal": 1.5, "hex": 2.0, "base32": 2.5, "base36": 2.0, "base64": 3.5}
UNIFORM_Z = 3.3
FDR = 0.01
BINS = 400
BIN_WIDTH = 0.05  # of -log10 p


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the usual rational approximation of erfc (error under 1.2e-7, relative)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the approximation.
    coef = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + c
    upper = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(token: Column) -> Column:
    """struct<enc, n, chi, chi_z, runs_z, serial_z> of a token: the chi-squared statistic and the tests' z-values."""
    # An '=' is padding, or stands between a name and a value: the longest part is tested.
    core = F.aggregate(F.split(token, "="), F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))

    def start(core: Column) -> Column:
        enc = (
            F.when(core.rlike("^[0-9]+$"), "decimal")
            .when(core.rlike("^[0-9a-f]+$") | core.rlike("^[0-9A-F]+$"), "hex")
            .when(core.rlike("^[A-Z2-7]+$"), "base32")
            .when(core.rlike("[0-9]") & (core.rlike("^[0-9a-z]+$") | core.rlike("^[0-9A-Z]+$")), "base36")
            .otherwise("base64")
        )
        return F.struct(enc.alias("enc"), F.when(enc.isin("hex", "base36"), F.lower(core)).otherwise(F.translate(core, "-_", "+/")).alias("t"))

    def tests(x: Column) -> Column:
        def measured(v: Column) -> Column:
            n = F.size(v).cast("double")
            a = _pick(x, SYMBOLS)
            squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(v, lambda y: y == s)).cast("double"), F.lit(2.0)))
            chi = squares * a / n - n
            mid = a / 2
            high = F.size(F.filter(v, lambda y: y >= mid)).cast("double")
            pairs = F.sequence(F.lit(1), F.size(v) - 1)
            runs = 1.0 + F.size(F.filter(pairs, lambda i: (F.get(v, i) >= mid) != (F.get(v, i - 1) >= mid)))
            mean = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y) / n
            var = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + (y - mean) * (y - mean))
            cov = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
            return F.struct(n.alias("n"), a.alias("a"), chi.alias("chi"), high.alias("high"), runs.alias("runs"), F.try_divide(cov, var).alias("r"))

        values = F.transform(F.split(x["t"], ""), lambda c: (F.position(c, _pick(x, ALPHABETS)) - 1).cast("double"))
        return let(values, lambda v: let(measured(v), lambda m: _verdict(x, m)))

    return let(core, lambda c: let(start(c), tests))


def _pick(x: Column, table: dict[str, object]) -> Column:
    """The value that the table has for the encoding of x."""
    out = F.when(x["enc"] == "decimal", F.lit(table["decimal"]))
    for k in ("hex", "base32", "base36", "base64"):
        out = out.when(x["enc"] == k, F.lit(table[k]))
    return out


def _verdict(x: Column, m: Column) -> Column:
    n, a = m["n"], m["a"]
    df = a - 1
    chi_z = (m["chi"] - df) / F.sqrt(2 * df)
    low = n - m["high"]
    expect = 1 + 2 * m["high"] * low / n
    spread = F.try_divide((expect - 1) * (expect - 2), n - 1)
    runs_z = F.coalesce(F.try_divide(m["runs"] - expect, F.sqrt(F.greatest(spread, F.lit(0.0)))), F.lit(99.0))
    serial_z = F.coalesce(m["r"], F.lit(1.0)) * F.sqrt(n)
    return F.struct(x["enc"].alias("enc"), n.alias("n"), m["chi"].alias("chi"), chi_z.alias("chi_z"), runs_z.alias("runs_z"), serial_z.alias("serial_z"))


def text_p(b: Column, divergence: dict[str, float]) -> Column:
    """The chance that ordinary text of this length looks as uniform as token b or more."""
    df = _pick(b, SYMBOLS) - 1
    shift = b["n"] * _pick(b, divergence)
    return F.greatest(1 - normal_tail((b["chi"] - df - shift) / F.sqrt(2 * (df + 2 * shift))), F.lit(1e-30))


def learned_divergence(candidates: DataFrame, z: float) -> dict[str, float]:
    """Non-centrality by character and encoding: the median of candidates (column b) that don't look uniform, and the prior."""
    b = F.col("b")
    own = F.greatest((b["chi"] - (_pick(b, SYMBOLS) - 1)) / b["n"], F.lit(0.0))
    rows = candidates.where(~uniform(b, z)).groupBy("b.enc").agg(F.count("*").alias("n"), F.percentile_approx(own, 0.5).alias("median")).collect()
    seen = {r["enc"]: (r["n"], r["median"]) for r in rows}
    return {k: (prior * PRIOR_TOKENS + seen.get(k, (0, 0.0))[0] * seen.get(k, (0, 0.0))[1]) / (PRIOR_TOKENS + seen.get(k, (0, 0.0))[0]) for k, prior in TEXT_DIVERGENCE.items()}


def uniform(b: Column, z: float = UNIFORM_Z) -> Column:
    """Whether no test of the battery rejects uniformity."""
    return (b["chi_z"] <= z) & (F.abs(b["runs_z"]) <= z) & (F.abs(b["serial_z"]) <= z)


def bh_threshold(counts: dict[int, int], total: int, q: float) -> float:
    """The largest -log10 p bin edge at which Benjamini-Hochberg at level q still rejects; inf if none does."""
    seen, best = 0, math.inf
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        # Every p of the bin is 10 ** -(b * width) at most.
        if 10 ** -(b * BIN_WIDTH) * total <= q * seen:
            best = b * BIN_WIDTH
    return best


def scan(docs: DataFrame, text: str = "text", q: float = FDR, z: float = UNIFORM_Z, keep_text: bool = True) -> DataFrame:
    """docs with assign, access, hex and random: arrays of spans (s, e in code points, m).

    Spans of one kind don't overlap; random spans overlap none of the others. Null and
    empty texts have none; the work on a long text is far from quadratic in its spans.
    The table is written to the shared folder once, since the threshold needs all
    candidates first, and without the text unless keep_text. Repeated rows are scanned
    alike; input columns of these names (and _t, _tok, _cand) are replaced. Empty in,
    empty out.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    staged = docs.withColumn("_t", t).drop(*KINDS, "_tok", "_cand")
    t = F.col("_t")
    assign = F.when(t.contains("=") | t.contains(":"), F.filter(spans_of("_t", ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 6)).otherwise(F.expr(no_spans()))
    access = F.when(t.contains("AKIA"), F.filter(spans_of("_t", ACCESS), lambda x: F.length(x["m"]) >= 20)).otherwise(F.expr(no_spans()))
    hexes = F.when(t.rlike(HEX), spans_of("_t", HEX)).otherwise(F.expr(no_spans()))
    staged = staged.withColumns({"assign": assign, "access": access, "hex": hexes, "_tok": F.when(t.rlike(TOKEN), spans_of("_t", TOKEN)).otherwise(F.expr(no_spans()))})
    free = apart("_tok", "concat(assign, access, hex)")
    staged = staged.withColumn("_cand", F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), battery(x["m"]).alias("b"))))
    staged = materialize(staged.drop("_t", "_tok", *([] if keep_text else [text])), "scan")

    candidates = staged.where(F.size("_cand") > 0).select(F.explode("_cand").alias("x")).select("x.b")
    divergence = learned_divergence(candidates, z)
    # The bin of a token, by -log10 p.
    place = lambda b: F.least(F.floor(-F.log10(text_p(b, divergence)) / BIN_WIDTH), F.lit(BINS)).cast("int")
    bins = candidates.groupBy(uniform(F.col("b"), z).alias("ok"), place(F.col("b")).alias("bin")).count().collect()
    total = sum(r["count"] for r in bins)
    cut = bh_threshold({r["bin"]: r["count"] for r in bins if r["ok"]}, total, q)
    passed = F.filter("_cand", lambda x: uniform(x["b"], z) & (place(x["b"]) * BIN_WIDTH >= F.lit(cut)))
    return staged.withColumn("random", F.transform(passed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))).drop("_cand")


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' spans by start, then kind as listed, comma-joined."""
    def numbered(kind: str, i: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    tagged = F.concat(*[numbered(k, i) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"), keep_text=False)
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every found span, overlapping ones together, replaced by `mark`.

    All rows and columns stay, whatever their names; null texts stay null.
    """
    renamed, names = numbered(docs)
    out = scan(renamed, names[text])
    return restored(out, names, **{text: replaced(names[text], f"concat({', '.join(KINDS)})", mark)})


def stage(docs: DataFrame) -> DataFrame:
    """redact(), with n_chars counted anew (null texts: null)."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


__all__ = ["battery", "bh_threshold", "digest", "learned_divergence", "normal_tail", "redact", "scan", "stage", "text_p", "uniform"]
