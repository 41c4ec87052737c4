"""The registered queries and the pipeline over the smallest tables."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mortonlake.llm import line_dedup, mixing, packing, quality_rules, queries
from mortonlake.llm.common import table

from ..conftest import DATA
from .test_small import brute_lines, check_pieces, check_windows, jaccard_sets


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_classifier_held_out(spark, duck):
    got = queries.QUERIES["op1_quality_classifier"](spark, DATA).toPandas().merge(duck.sql("SELECT doc_id, quality FROM labels").df(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_neighbours_recall(spark, duck):
    e = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    got = queries.QUERIES["op4_nearest"](spark, DATA).toPandas()
    hit = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[got.query_id == ids[i]].vec_id))
    assert hit >= 0.9 * 20 * len(asked)


def test_language_model_beats_word_counts(spark):
    """Held out, the mean score is above that of the word counts, which give a single unknown word no spelling."""
    got = queries.QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.1").toPandas()
    held = got[got.held_out]
    print("held out, log10 a word:", held.score.sum() / held.n_tokens.sum(), "word counts:", held.base_score.sum() / held.n_tokens.sum())
    assert len(got) == 10_000 and held.score.sum() > held.base_score.sum()


def test_pipeline(spark, duck):
    """Each stage's result equals a brute-force version of it on what the stage before kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    read, before = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        before = table(after, "test-stage")
        read.append(sorted(before.collect(), key=lambda r: r.doc_id))
    ruled, lined, alone, mixed = read

    assert [r.doc_id for r in ruled] == [x for (x,) in duck.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept ORDER BY 1").fetchall()]

    gone = brute_lines([(r.doc_id, r.text) for r in ruled], line_dedup.MIN_WORDS)
    want = {}
    for k, r in enumerate(ruled):
        lines = r.text.split("\n")
        if len(gone[k]) < sum(bool(x.encode().split()) for x in lines):
            want[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone[k])
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)

    sets, seen, least = jaccard_sets([r.text for r in lined]), set(), []
    for i in range(len(lined)):
        if i in seen:
            continue
        least.append(lined[i].doc_id)
        todo = [i]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [y for y in range(len(lined)) if y not in seen and sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8]
    assert [r.doc_id for r in alone] == least

    used = Counter(r.doc_id for r in mixed)
    assert set(used) == set(least) and max(used.values()) <= 2
    tok = Tokenizer.from_file(packing.tokenizer_path())
    size = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in alone}
    tokens, drawn = Counter(), Counter()
    for r in alone:
        tokens[r.source] += size[r.doc_id]
        drawn[r.source] += size[r.doc_id] * used[r.doc_id]
    most = max(tokens.values())
    repeats = {s: drawn[s] / n for s, n in tokens.items()}
    assert repeats[max(tokens, key=tokens.get)] == 1 and max(repeats.values()) <= mixing.MAX_REPEATS
    a = 1 - np.log(mixing.MAX_REPEATS) / np.log(most / min(tokens.values()))
    for s, n in tokens.items():
        share = max(size[r.doc_id] for r in alone if r.source == s) / n  # a block is a document here
        assert (most / n) ** (1 - a) - share - 1e-3 <= repeats[s] <= (most / n) ** (1 - a) + 1e-3

    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    by_doc, by_seq = check_pieces(None, pieces)
    check_windows(by_seq)
    for r in alone:
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        assert sum(p.length for p in by_doc[r.doc_id]) == len(ids) * used[r.doc_id]
        for p in by_doc[r.doc_id]:
            assert p.ids == np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
    # two pipelines in a session do not touch each other's tables
    first, second = corpus_pipeline.run(spark, DATA), corpus_pipeline.run(spark, DATA)
    assert first.count() == second.count() == len(pieces)


def test_order_of_the_mix(spark):
    """The rows of the mixing stage's files are in the order of the mix, and packing's sequences follow it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = corpus_pipeline.mixture(spark, docs, DATA)
    stored = table(mixed, "test-mixed")
    order = corpus_pipeline.written_order(stored)
    got = [r.doc_id for r in stored.withColumn("o", order).orderBy("o").collect()]
    seen, again = set(), 0
    for d in got:  # later epochs after the first
        again += d in seen
        assert d in seen or not again
        seen.add(d)
    assert again and corpus_pipeline.written_order(docs.filter("doc_id > 3").groupBy("doc_id", "text").count()) is None
    place = {d: k for k, d in reversed(list(enumerate(got)))}
    first = {}
    for p in corpus_pipeline.packed(spark, stored, DATA).collect():
        first[p.sequence_id] = min(first.get(p.sequence_id, 1 << 60), place[p.doc_id])
    assert sorted(first) == list(range(len(first)))


@pytest.mark.parametrize("texts", [[], [None, None, ""]])
def test_pipeline_of_little(spark, tmp_path, texts):
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
