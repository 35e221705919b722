"""Personal data by weak supervision.

Four base patterns (email, ip, card, phone) are found exactly. Looser candidates
(numbers laid out like phones or identifiers, spelled-out addresses, names after a form of
address) are judged by labelers: regular expressions on the candidate, a gazetteer of
words near it and the context before and after it. Each votes yes, no or nothing.
Expectation-maximisation over the counts of vote patterns of the whole corpus (at most
3^6 rows for a kind) estimates how reliable each labeler is. The final span classifier is
a logistic one over the votes and over features of the span and its surroundings that no
labeler sees; it is fitted to the posteriors of all candidates, counted by votes and
features (3^6 * 2^6 rows for a kind at most), and adds the spans that it accepts. Base
spans stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm._common import apart, materialize, no_spans, spans_of, written

# Fixed values of the base patterns; quantifiers are possessive or anchored where that changes no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_FITS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# Looser candidates of the method.
LOOSE = {
    "xphone": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z])",
    "xemail": r"(?i)\b[a-z0-9._-]{2,64}\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{2,64}(?:\x20?(?:\(dot\)|\[dot\])\x20?[a-z]{2,12}|\.[a-z]{2,12})++",
    "xid": r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+)(?![0-9A-Za-z])",
    "xname": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
#: A text without this can hold no candidate of the kind.
NEEDS = {"xphone": r"[0-9]{2}[\x20./)-]", "xemail": r"(?i)[\[(]at[\])]", "xid": r"[0-9]{2}", "xname": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20"}
ALL_KINDS = KINDS + tuple(LOOSE)
#: Words that announce personal data.
GAZETTEER = (
    "call phone telephone tel mobile cell fax whatsapp sms contact reach email e-mail mail write ssn social security passport iban account "
    "telefon handy anruf kontakt konto ausweis téléphone portable appeler courriel compte teléfono llamar correo cuenta pasaporte"
).split()
#: Words that speak against it.
AGAINST = "version v chapter section page figure table isbn issn rfc build release no year years score ratio price".split()
CONTEXT = 30
LABELERS = ("shape", "strict", "gazetteer", "before", "after", "against")
#: What the classifier sees besides the votes; each is true or false.
FEATURES = ("many digits", "letters", "long", "one separator", "starts a line", "goes on in lower case")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(name: str) -> dict[str, Column]:
    """Spans of the base kinds in a column of texts without nulls."""
    t = F.col(name)
    card_ok = lambda x: F.length(_digits(x["m"])).between(16, 19) & F.call_function("luhn_check", _digits(x["m"]))
    digit = t.rlike("[0-9]")
    return {
        "email": F.when(t.contains("@"), spans_of(name, EMAIL)).otherwise(F.expr(no_spans())),
        "ip": F.when(t.rlike(r"[0-9]\.[0-9]"), F.filter(spans_of(name, IP), lambda x: x["m"].rlike(IP_FITS))).otherwise(F.expr(no_spans())),
        "card": F.when(digit & t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), F.filter(spans_of(name, CARD), card_ok)).otherwise(F.expr(no_spans())),
        "phone": F.when(t.contains("+"), F.filter(spans_of(name, PHONE), lambda x: F.length(_digits(x["m"])).between(8, 15))).otherwise(F.expr(no_spans())),
    }


def votes(kind: str, x: Column) -> list[Column]:
    """+1, -1 or 0 by each of LABELERS for candidate x (m, and l and r, the text on both sides)."""
    before, after = F.lower(x["l"]), F.lower(x["r"])
    words = r"(?<!\p{L})(?:" + "|".join(GAZETTEER) + r")(?!\p{L})"
    no = r"(?<!\p{L})(?:" + "|".join(AGAINST) + r")\.?\s*$"
    n = F.length(_digits(x["m"]))
    shape = {"xphone": n.between(9, 12), "xemail": x["m"].rlike(r"(?i)(?:dot|\.)"), "xid": n >= 9, "xname": x["m"].rlike(r"\p{Ll}{3}")}[kind]
    strict = {"xphone": x["m"].rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), "xemail": x["m"].rlike(r"(?i)[\[(]dot"), "xid": x["m"].rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}"), "xname": x["m"].rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}")}[kind]
    one = lambda c, yes=1, other=0: F.when(c, F.lit(yes)).otherwise(F.lit(other))
    return [
        one(shape, 1, -1),
        one(strict, 1, -1),
        one(F.concat(before, F.lit(" "), after).rlike(words)),
        one(before.rlike(r"(?:" + "|".join(GAZETTEER) + r")\.?\s*[:#]?\s*(?:\p{L}{1,4}\s)?$")),
        one(after.rlike(r"^\s*(?:[.,;)]|$)"), 1, 0),
        one(before.rlike(no), -1, 0),
    ]


def features(x: Column) -> list[Column]:
    """0 or 1 by each of FEATURES for candidate x."""
    m = x["m"]
    holds = [F.length(_digits(m)) >= 10, m.rlike(r"\p{L}"), F.length(m) >= 14, ~m.rlike(r"[./-].*\x20|\x20.*[./-]"), x["l"].rlike(r"(?:^|\n)\s*$"), x["r"].rlike(r"^[\x20,]*\p{Ll}")]
    return [c.cast("int") for c in holds]


def code(vote: list[Column], feature: list[Column]) -> Column:
    """Votes in base 3, then features in base 2, as one number."""
    out = F.lit(0)
    for v in vote:
        out = out * 3 + v + 1
    for f in feature:
        out = out * 2 + f
    return out


def decode(number: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(votes, features) of a number made by code()."""
    f, v = [], []
    for _ in FEATURES:
        number, bit = divmod(number, 2)
        f.append(bit)
    for _ in LABELERS:
        number, vote = divmod(number, 3)
        v.append(vote - 1)
    return tuple(reversed(v)), tuple(reversed(f))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """The posterior of a true candidate by vote pattern.

    counts: candidates by pattern. Expectation-maximisation for the share of true
    candidates and each labeler's chance of voting yes, no or nothing on true and false
    ones, with the prior weight of ten candidates, so that a few rows don't turn a labeler
    round.
    """
    # A labeler starts out trusted: its yes is three times as likely on a true candidate.
    p, like = 0.5, {y: [{1: 0.6, 0: 0.3, -1: 0.1} if y else {1: 0.2, 0: 0.3, -1: 0.5} for _ in LABELERS] for y in (0, 1)}

    def posterior(v: tuple[int, ...]) -> float:
        a, b = math.log(p), math.log(1 - p)
        for j, x in enumerate(v):
            a, b = a + math.log(like[1][j][x]), b + math.log(like[0][j][x])
        return 1 / (1 + math.exp(min(700, b - a)))

    for _ in range(rounds):
        post = {v: posterior(v) for v in counts}
        total, yes = sum(counts.values()), sum(n * post[v] for v, n in counts.items())
        p = (yes + 1) / (total + 2)
        for y in (0, 1):
            w = {v: n * (post[v] if y else 1 - post[v]) for v, n in counts.items()}
            prior = {1: 6, 0: 3, -1: 1} if y else {1: 2, 0: 3, -1: 5}
            like[y] = [{x: (sum(k for v, k in w.items() if v[j] == x) + prior[x]) / (sum(w.values()) + 10) for x in (1, 0, -1)} for j in range(len(LABELERS))]
    return {v: posterior(v) for v in counts}


def fit(counts: dict[int, int], steps: int = 300) -> dict[int, float]:
    """The classifier's probability by code(); counts: candidates by code(). Empty in, empty out.

    Logistic regression of the votes' posteriors on votes and features, by gradient steps
    with a small penalty.
    """
    rows = {c: decode(c) for c in counts}
    by_votes: dict[tuple[int, ...], int] = {}
    for c, (v, _) in rows.items():
        by_votes[v] = by_votes.get(v, 0) + counts[c]
    post = reliabilities(by_votes)
    inputs = {c: (*v, *f, 1) for c, (v, f) in rows.items()}
    weights = [0.0] * (len(LABELERS) + len(FEATURES) + 1)
    total = sum(counts.values())
    chance = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
    for _ in range(steps):
        grad = [0.02 * w for w in weights]
        for c, x in inputs.items():
            err = (chance(x) - post[rows[c][0]]) * counts[c] / total
            for j, value in enumerate(x):
                grad[j] += err * value
        weights = [w - 0.5 * g for w, g in zip(weights, grad, strict=True)]
    return {c: chance(x) for c, x in inputs.items()}


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["v"].alias("v")))


def find(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs (without the text) with an array of spans (s, e in code points, m) for each of ALL_KINDS.

    Spans of one kind don't overlap; added ones overlap no base span, and phones no identifier. Null and empty texts
    have none; the work on a long text is far from quadratic in its spans. Written to the
    shared folder once: the votes of all candidates come first. Repeated rows are judged
    alike; input columns of these names (and _t, and those of LOOSE after an underscore) are replaced. Empty in, empty out.
    """
    staged = docs.withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit(""))).drop(*ALL_KINDS)
    t = F.col("_t")
    staged = staged.withColumns(base_spans("_t"))
    staged = staged.withColumns({f"_{k}": F.when(t.rlike(NEEDS[k]), spans_of("_t", LOOSE[k], CONTEXT)).otherwise(F.expr(no_spans(CONTEXT))) for k in LOOSE})

    def loose(kind: str) -> Column:
        # What is laid out like an identifier is no phone number.
        also = ["transform(_xid, y -> named_struct('s', y.s, 'e', y.e, 'm', y.m))"] if kind == "xphone" else []
        free = apart(f"_{kind}", f"concat({', '.join([*KINDS, *also])})")
        return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), code(votes(kind, x), features(x)).alias("v")))

    staged = materialize(staged.withColumns({k: loose(k) for k in LOOSE}).drop("_t", text, *[f"_{k}" for k in LOOSE]), "candidates")
    tagged = F.concat(*[_tagged(k) for k in LOOSE])
    counted: dict[str, dict[int, int]] = {k: {} for k in LOOSE}
    for r in staged.where(" or ".join(f"size({k}) > 0" for k in LOOSE)).select(F.explode(tagged).alias("x")).groupBy("x.kind", "x.v").count().collect():
        counted[r["kind"]][r["v"]] = r["count"]
    chosen = {k: [c for c, p in fit(n).items() if p >= threshold] for k, n in counted.items()}
    keep = lambda k: F.filter(k, lambda x: x["v"].isin(chosen[k]) if chosen[k] else F.lit(False))
    return staged.withColumns({k: F.transform(keep(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))) for k in LOOSE})


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return F.array_join(F.concat(*[written(F.col(k), k) for k in kinds]), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"))
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed(ALL_KINDS).alias("spans"))
