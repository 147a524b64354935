import collections
import random
import re

from wirelattice.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def judged(spark, docs, labels):
    out = quality.judge(docs, labels).drop("row")
    return out.collect()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(seed=1):
    r = random.Random(seed)
    good = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(r.choice(good) for _ in range(120)), "s"))
    for i in range(60, 75):
        rows.append((i, " ".join(r.choice(good) + r.choice(["###", "$$$", "%%%"]) for _ in range(120)), "s"))
    return rows


def test_base_columns_against_brute_force(spark, documents, hard):
    r = random.Random(7)
    rows = hard[:3] + hard[4:5] + [(10 + i, "".join(r.choice(["a ", "b ", "c\n", "#", "x|y ", "\t", "\n"]) for _ in range(r.randint(0, 60))), "s") for i in range(60)]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in judged(spark, documents(rows), labels(spark, []))}
    assert got == {i: base(t) for i, t, _ in rows}


def test_verdicts(spark, documents):
    rows = corpus()
    lab = [(i, int(i < 60), 0) for i in list(range(0, 40)) + list(range(60, 70))]
    got = {r["doc_id"]: r for r in judged(spark, documents(rows), labels(spark, lab))}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 75))
    again = {r["doc_id"]: r["llr"] for r in judged(spark, documents(rows[::-1]).repartition(5), labels(spark, lab))}
    assert again == {i: r["llr"] for i, r in got.items()}


def test_score_against_brute_force(spark, documents):
    import math

    rows, lab = corpus(3), [(i, 1, 0) for i in range(30)]
    got = {r["doc_id"]: r["llr"] for r in judged(spark, documents(rows), labels(spark, lab))}
    # without collisions the buckets are the grams themselves
    grams = {i: [*(w := t.split()), *zip(w, w[1:])] for i, t, _ in rows}
    raw, good = collections.Counter(g for v in grams.values() for g in v), collections.Counter(g for i in range(30) for g in grams[i])
    share, a = sum(good.values()) / sum(raw.values()), quality.SHRINK
    want = {i: sum(math.log((good[g] + a * share) / ((raw[g] + a) * share)) for g in v) / len(v) for i, v in grams.items()}
    assert all(abs(got[i] - want[i]) < 0.02 for i in want)


def test_edge_cases_and_columns(spark, documents, hard):
    docs = documents(hard)
    out = quality.keep_good(docs, labels(spark, [(4, 1, 0), (4, 0, 0), (None, 1, 0)]))
    assert out.columns == docs.columns and out.count() == 0
    assert quality.judge(docs, labels(spark, [])).count() == len(hard)
    assert quality.judge(docs.limit(0), labels(spark, [(1, 1, 0)])).count() == 0
