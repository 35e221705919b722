"""Recall and precision of the kinds that the given tables don't hold, on a planted corpus of 3,000 documents."""

import base64
import random

import pytest

from quantloom.llm import pii, secrets


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(1_500)]
    return rng, lambda n: " ".join(rng.choices(vocabulary, k=n))


def spans(rows, kinds):
    out = set()
    for r in rows:
        for x in filter(None, r["spans"].split(",")):
            kind, s, e = x.split(":")
            if kind in kinds:
                out.add((r["doc_id"], kind, int(s), int(e)))
    return out


def scores(got, want):
    """(recall, precision) of spans."""
    return len(got & want) / len(want), len(got & want) / max(1, len(got))


def test_personal_data(spark, prose):
    rng, text = prose
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: "".join(rng.choices("abcdeilmnorstu", k=rng.randint(4, 8))).capitalize()
    planted = {
        "xphone": lambda: (rng.choice(["call ", "Phone: ", "mobile ", "telefon "]), f"{d(3)}-{d(3)}-{d(4)}" if rng.random() < 0.6 else f"({d(3)}) {d(3)}-{d(4)}"),
        "xemail": lambda: (rng.choice(["write to ", "email ", "contact "]), f"{name().lower()} (at) {name().lower()} (dot) com"),
        "xid": lambda: (rng.choice(["SSN ", "passport ", "social security "]), f"{d(3)}-{d(2)}-{d(4)}"),
        "xname": lambda: ("with ", f"{rng.choice(['Dr.', 'Mrs.', 'Herr', 'Prof.'])} {name()} {name()}"),
    }
    decoys = [lambda: f"version {d(2)}.{d(2)}.{d(3)}", lambda: f"score {d(2)}-{d(2)}-{d(2)}", lambda: f"isbn {d(3)} {d(2)} {d(5)}", lambda: f"ratio {d(2)}/{d(2)}/{d(2)}", lambda: f"year {d(4)}", lambda: f"table {d(2)} {d(2)} {d(3)}"]
    rows, want = [], set()
    for i in range(3_000):
        t = text(rng.randint(20, 60)) + " "
        if i % 3 == 0:
            kind = rng.choice(list(planted))
            lead, what = planted[kind]()
            t += lead
            want.add((i, kind, len(t), len(t) + len(what)))
            t += what + rng.choice([". ", ", ", " "])
        elif i % 3 == 1:
            t += rng.choice(decoys)() + " "
        rows.append((i, t + text(rng.randint(20, 60))))
    got = spans(pii.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), planted)
    for kind in planted:
        r, p = scores({x for x in got if x[1] == kind}, {x for x in want if x[1] == kind})
        print(f"{kind}: recall {r:.3f}, precision {p:.3f}")
        assert r >= 0.9 and p >= 0.9
    # One span is of one kind.
    assert len({(i, s, e) for i, _, s, e in got}) == len(got)


def test_random_secrets(spark, prose):
    rng, text = prose
    raw = lambda n: bytes(rng.randrange(256) for _ in range(n))
    rows, want = [], set()
    for i in range(3_000):
        t = text(rng.randint(20, 60)) + " "
        if i % 4 == 0:
            what = base64.b64encode(raw(rng.choice([33, 48, 60]))).decode()
            want.add((i, "random", len(t), len(t) + len(what)))
            t += what + " "
        elif i % 4 == 1:
            # Long words, paths and joined names are no secrets.
            t += rng.choice(["/".join(text(6).split()), "".join(w.capitalize() for w in text(7).split()), "_".join(text(6).split())]) + " "
        rows.append((i, t + text(rng.randint(20, 60))))
    got = spans(secrets.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), {"random"})
    r, p = scores(got, want)
    print(f"random: recall {r:.3f}, precision {p:.3f}")
    assert r >= 0.9 and p >= 0.9
