import random
import re

from lodeseek.llm import quality_rules as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    counts = [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]
    return [*counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]]


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b c d e", "a b c d e f", "x " * 40, "\n\nq\n q\nq\n", "é ü | <b>\x0b\x0cß 漢字   x y", "a b c d e\na b c d e a b c d e"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", " d", "#*", "\t"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(30_000)))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = op.judge(docs, []).select("own.doc_id", *op.COUNTS, "base_failed", "kept").collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r)[1:7] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept != r.base_failed


def test_learns_and_keeps_clean(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        junk = i % 5 == 0
        rows.append((i, " ".join(w + rng.choice(["***", "###"]) * junk for w in words)))
        labels.append((i, 0 if junk else 1, 0))
    labels += [(1, 0, 0), (None, 0, 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = op.fit_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules and all(1 <= len(rule) <= op.TESTS for rule in rules)
    got = op.judge(docs, rules).select("own.doc_id", "kept").collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.fit_rules(docs, labels) == []
    assert op.judge(docs, []).count() == 0
    assert op.learn_rules([([1.0] * len(op.MEASURES), False)] * 5) == []
