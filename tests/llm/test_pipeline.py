"""The whole pipeline against a plain Python version on a small fixture."""

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import xxhash
from tokenizers import Tokenizer

from quantloom.llm.tokens import default_tokenizer


def fingerprint(text):
    words = text.lower().split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def contaminated(text, items):
    words = re.findall(r"[a-z0-9]+", text.lower())
    hit = set()
    for item in items:
        w = re.findall(r"[a-z0-9]+", item.lower())
        windows = {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))}
        for k in {len(x) for x in windows}:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit.update(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_run_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    items = [prose(30), prose(6)]
    texts = [prose(60) for _ in range(12)]
    texts += [texts[3], texts[3], texts[5], prose(5), "", None]
    texts += [prose(30) + " " + items[0] + " " + prose(30), prose(20) + " " + items[1]]
    texts += [prose(40) + " password = Zx81kQ0vTr77 " + prose(20)]
    secret = len(texts) - 1
    # A line of furniture goes and its document stays; one that loses most goes; so does one of lines without an end.
    texts += [prose(40) + "\nClick here to subscribe now.\n" + prose(30), prose(8) + "\n" + "Click here to subscribe now.\n" * 3, "\n".join(prose(2).rstrip(".") for _ in range(9))]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    # A null id and a repeated row.
    alone = prose(50)
    rows += [(None, alone, None, None, None), rows[1], rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def cleaned(text):
        lines = [x for x in (text or "").split("\n") if x.split()]
        good = [x for x in lines if "click here" not in x.lower() and (len(x.split()) > 3 or x[-1] in ".!?")]
        return "\n".join(good) if len((text or "").split()) >= 10 and 2 * sum(map(len, good)) >= sum(map(len, lines)) else None

    kept = [(i, cleaned(t)) for i, t, *_ in rows[:-2] if cleaned(t) is not None]
    assert [i for i, _ in kept[-2:]] == [secret + 1, None]
    left = [(i if i is not None else len(texts), t) for i, t in kept]
    prints = {i: fingerprint(t) for i, t in left}
    links = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3] for i in prints}

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        return min(seen)

    left = {i: t for i, t in left if component(i) == i and not contaminated(t, items)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {len(texts) if r["doc_id"] is None else r["doc_id"]: r["n_tokens"] for r in out}
    assert set(got) == set(left) and len(out) == len(left)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert {i: n for i, n in got.items() if i != secret} == {i: count(t) for i, t in left.items() if i != secret}
    assert got[secret] != count(texts[secret])


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (None, c), (3, d), (9, e), (9, e), (None, ""), (None, "")]
    prints = [fingerprint(t) for t in (a, b, c, d, e)]
    assert all((x ^ y).bit_count() > 3 for x, y in combinations([0, *prints], 2))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(None, a), (None, b), (7, c), (3, d), (9, e), (None, "")]) and out.columns == docs.columns
    # Two documents with one id that nothing else is like both stay.
    two = docs.where("doc_id = 7")
    assert Counter(r["text"] for r in corpus_pipeline.near_duplicates(spark, two, "").collect()) == Counter([c, d])
