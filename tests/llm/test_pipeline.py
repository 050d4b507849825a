import hashlib
import re
from collections import Counter

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodeseek.llm import quality_rules
from lodeseek.llm.queries import tokenizer_path
from tests.llm import test_mixing, test_quality_rules, test_setsketch


def test_equals_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.unionByName(source.limit(20).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = {r.doc_id: r for r in docs.collect()}
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    # rules are few; their verdicts are recomputed from plain Python measures
    def measures(text):
        n, chars, symbols, dups, repeats, _ = test_quality_rules.brute(text)
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return dict(zip(quality_rules.MEASURES, [symbols / max(n, 1), chars / max(n, 1), repeats / max(n, 1), dups / max(len(lines), 1), len(re.findall("[A-Z]", text)) / max(chars, 1), text.count("!") / max(n, 1), len(set(words)) / max(n, 1), len(re.findall("[0-9]", text)) / max(chars, 1)]))

    def kept(text):
        m = measures(text)
        return not test_quality_rules.brute(text)[5] and not any(all((m[t.measure] > t.cut) == t.above for t in rule) for rule in rules)

    left = [r for r in rows.values() if kept(r.text)]
    best = {}
    for r in left:
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    left = [r for r in left if best[r.text] == r.doc_id]
    near = test_setsketch.brute([(r.doc_id, r.text) for r in left], 5, 80)
    stays = {d for d, _, c in near if d == c}
    left = [r for r in left if str(r.doc_id) in stays]
    taken = test_mixing.brute([(r.doc_id, r.text, r.source) for r in left])
    copies = {d: words // size for d, (size, _, _, words) in taken.items() if words}
    assert Counter(r.doc_id for r in got) == Counter(copies)
    full = Tokenizer.from_file(tokenizer_path())
    for r in got:
        assert r.ids == full.encode(rows[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0
    assert {"pipeline", "op1_exact_dedup"} <= __spark_entry__.queries().keys()
