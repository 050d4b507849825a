import random
import re

import regex

from lodeseek.llm import license_scan as op


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_spans(words, spans, scanner):
    """Spans against all runs of words within the edits, by brute-force distance."""
    by_label = {}
    for notice, label, edits, _ in scanner.notices:
        for i in range(len(words)):
            for j in range(i, len(words)):
                run = " ".join(words[i : j + 1])
                if len(run) > len(notice) + edits:
                    break
                if len(run) >= len(notice) - edits and (d := distance(run, notice)) <= edits:
                    by_label.setdefault(label, []).append((i, j, d))
    for label, i, j, d in spans:
        assert (i, j, d) in by_label.get(label, []), (label, i, j, d)
    for label, runs in by_label.items():
        own = [(a, b, e) for x, a, b, e in spans if x == label]
        for i, j, d in runs:  # what is not told overlaps what is told and is no worse
            assert any(a <= j and i <= b and e <= d for a, b, e in own), (label, i, j, d)


def test_operator(spark):
    rng = random.Random(5)
    filler = "the of and license apache general public gnu cc by mit code café x2".split()
    texts = [None, "", "...", "MIT License", "cc by cc by CC-BY", "GNU  General,Public\nLicense", "gnu general public licenses", "commit license"]
    for notice in op.NOTICES:
        for wrong in (0, 1, 3):
            own = list(notice)
            for _ in range(wrong):
                i = rng.randrange(len(own))
                own[i : i + 1] = rng.choice(["", "q", own[i] + "z"])
            texts.append(" ".join(rng.choice(filler) for _ in range(30)) + " " + "".join(own).title() + "; " + " ".join(rng.choice(filler) for _ in range(9)))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in op.license_scan(docs).collect()}
    scanner = op.Scanner()
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
        places = sorted((label, k) for phrase, label in op.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (got[i].n_words, sorted((p.label, p.word) for p in got[i].places)) == (len(words), places)
        check_spans(words, [(s.label, s.first_word, s.last_word, s.edits) for s in got[i].spans], scanner)
        for s in got[i].spans:
            assert 0 <= s.first_word <= s.last_word < len(words) and 0 < s.likeness <= 1
    for k, notice in enumerate(op.NOTICES):
        assert any(s.label == op.NOTICES[notice] and s.edits == 0 and s.first_word == 30 for s in got[8 + 3 * k].spans)
    assert op.license_scan(docs.limit(0)).count() == 0


def test_long_text_and_repeats():
    text, n = op.normal("mit license " * 20_000)
    scanner = op.Scanner()
    assert n == 40_000 and [w for _, w in scanner.exact(text)] == list(range(0, 40_000, 2))
    assert regex.__version__


def test_notices_that_follow_each_other():
    scanner = op.Scanner()
    text, _ = op.normal("x released under the mit licence and released under the mit license y")
    assert [s[1:4] for s in scanner.fuzzy(text)] == [(1, 5, 1), (7, 11, 0)]
    text, _ = op.normal("released under the mit license " * 3 + "released undr the mit license " * 3)
    assert [s[1:4] for s in scanner.fuzzy(text)] == [(5 * i, 5 * i + 4, int(i > 2)) for i in range(6)]


def test_many_neighbours():
    scanner = op.Scanner()
    text, _ = op.normal("released under the mit license " * 200)
    assert [s[1:4] for s in scanner.fuzzy(text)] == [(5 * i, 5 * i + 4, 0) for i in range(200)]
    rng = random.Random(2)
    notices = {"may be used freely": "free", "free use of this text": "use"}
    small = op.Scanner({}, notices, 6)
    for _ in range(60):
        words = []
        for _ in range(4):
            own = list(rng.choice(list(notices)))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(["", "q", own[k] + "z"])
            words += "".join(own).split() + rng.choice([[], ["and"], ["freely", "used"]])
        check_spans(words, [s[:4] for s in small.fuzzy(op.normal(" ".join(words))[0])], small)


def test_own_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([("It may be  used FREELY.", 1)] * 2 + [(None, 2)], "text string, spans int")
    got = op.license_scan(docs, phrases={"be used": "p"}, notices={"may be used freely": "free"}, per_edit=6).collect()
    assert [(r.n_words, [tuple(p) for p in r.places], [tuple(s)[:4] for s in r.spans]) for r in got] == [(5, [("p", 2)], [("free", 1, 4, 0)])] * 2 + [(0, [], [])]
