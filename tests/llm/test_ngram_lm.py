import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodeseek.llm import ngram_lm as op


def tokens_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows, order):
    """Straightforward model with exact held-out EM (no cells)."""
    kind = [0 if d is None else zlib.crc32(str(d).encode()) % 7 for d, _ in rows]
    texts = [tokens_of(t) for _, t in rows]

    def model(use):
        grams, contexts = Counter(), Counter()
        for t, k in zip(texts, kind):
            if use(k):
                padded = ["<s>"] * (order - 1) + t
                for i in range(len(t)):
                    for n in range(1, order + 1):
                        gram = tuple(padded[i + order - n : i + order])
                        grams[gram] += 1
                        contexts[n, gram[:-1]] += 1
        return grams, contexts, len({g for g in grams if len(g) == 1})

    def estimates(m, t):
        grams, contexts, v = m
        padded = ["<s>"] * (order - 1) + t
        for i in range(len(t)):
            own = [tuple(padded[i + order - n : i + order]) for n in range(1, order + 1)]
            seen = [contexts[n, g[:-1]] for n, g in enumerate(own, 1)]
            yield (int(math.log2(seen[-1])) + 1 if seen[-1] else 0), [1 / (v + 1)] + [grams[g] / s if s else 0 for g, s in zip(own, seen)], [1] + [s > 0 for s in seen]

    fit, full = model(lambda k: k not in (2, 3)), model(lambda k: k != 2)
    cells = {}
    for t, k in zip(texts, kind):
        if k == 3:
            for b, p, _ in estimates(fit, t):
                cells.setdefault(b, []).append(p)
    mix = {}
    for b, own in cells.items():
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(op.ROUNDS):
            new = [0.0] * (order + 1)
            for p in own:
                total = sum(x * y for x, y in zip(w, p))
                new = [n + x * y / total for n, x, y in zip(new, w, p)]
            w = [max(n / len(own), 1e-9) for n in new]
        mix[b] = [x / sum(w) for x in w]
    n = sum(len(t) for t, k in zip(texts, kind) if k != 2)
    out = []
    for (d, _), t, k in zip(rows, texts, kind):
        c = [full[0][(x,)] for x in t]
        score = 0.0
        for b, p, seen in estimates(full, t):
            w = mix[min(mix, key=lambda x: (abs(x - b), x))] if mix else [1 / (order + 1)] * (order + 1)
            score += math.log10(sum(x * y for x, y in zip(w, p)) / sum(x * y for x, y in zip(w, seen)))
        out.append((str(d), k == 2, len(t), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + full[2] + 1)) for x in c), score))
    return sorted(out)


@pytest.mark.parametrize("order, chunk", [(2, 700), (3, 10**6), (1, 300)])
def test_equals_brute_force(spark, order, chunk):
    rng = random.Random(order)
    words = [f"w{i}" for i in range(60)] + ["Über", "é"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 62])]).title() for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(None, "a null id"), (500, None), (501, ""), (501, ""), (502, "x" * 100_000 + " w1\n\tw2")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted((str(r.doc_id), *list(r)[1:]) for r in op.lm_scores(docs, order, chunk_tokens=chunk, part_tokens=200).collect())
    for a, b in zip(got, brute(rows, order), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=0.02)


def test_edges(spark):
    assert op.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = op.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
