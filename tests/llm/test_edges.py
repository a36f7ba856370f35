"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import context_mixing, decontaminate, host_rules, language_id, secrets, sentence_spans, simhash, toxicity
from quern.llm.piece_bpe import PieceModel, encode_pieces
from quern.llm.token_counts import count_tokens

LONG = "the quick brown fox jumps over the lazy dog. " * 4000
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, spans string, items string, row string, fp long, host string, n int, label int, of long, hash long, tuning int, number long"
ROWS = [
    (1, "le chat est sur la table et il dort bien.", "fr", "a", 10),
    (1, "le chat est sur la table et il dort bien.", "fr", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "b", 5),
    (None, "the cat is on the table and it sleeps well.", "en", None, 3),
    (None, None, None, None, None),
    (5, " \n\t ", "en", "a", 4),
    (6, "12345 --- !!!", "en", "a", 13),
    (7, "the cat is on the table and it sleeps well.", "en", "b", 3),
]
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9, 0.5, "s", "i", "r", 7, "h", 2, 1, 4, 3, 1, 6) for r in ROWS], SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a passage that nobody holds at all, however long one looks for it"), (None, None), (3, "")], "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


OPERATORS = {
    "language": lambda d, items: language_id.label_spans(d, language_id.train(d, F.lit(True))),
    "rules": lambda d, items: host_rules.judge(d),
    "secrets": lambda d, items: secrets.digests(secrets.scan_secrets(d)),
    "benchmark": lambda d, items: decontaminate.contaminated(d, items),
    "benchmark blocks": lambda d, items: decontaminate.contaminated(d, items.unionAll(items), block_bytes=1),
    "mixing": lambda d, items: context_mixing.score_texts(d, F.lit(True)),
    "sentences": lambda d, items: sentence_spans.drop_repeated_spans(d),
    "simhash": lambda d, items: simhash.near_duplicates(d),
    "tokens": lambda d, items: count_tokens(d, BYTES),
    "tokens of pieces": lambda d, items: count_tokens(d, PIECES),
    "pieces": lambda d, items: encode_pieces(d, PIECES),
    "toxicity": lambda d, items: toxicity.score(d, toxicity.train(d, labels(d.sparkSession, [(4, 1), (7, 0), (1, 0), (None, 1), (5, None)]), F.lit(True), language_id.train(d, F.lit(True)))),
    "toxicity unlabelled": lambda d, items: toxicity.score(d, toxicity.train(d, labels(d.sparkSession, []), F.lit(True), language_id.train(d, F.lit(True)))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(name, odd, empty, items):
    found = OPERATORS[name](odd, items).collect()
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(found) == ids([{"doc_id": r[0]} for r in ROWS])
    assert OPERATORS[name](empty, items).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_defined_results(odd, items):
    found = by_id(OPERATORS["language"](odd, items))
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (2, 3, 5, 6)] == [("und", 0.0)] * 4
    assert found[4]["lang_pred"] == "en" and found[1]["lang_pred"] == "fr"
    found = by_id(OPERATORS["rules"](odd, items))
    assert (found[2]["n_words"], found[2]["base_failed"], found[2]["kept"]) == (0, True, False)
    assert found[4]["n_repeat_words"] == found[4]["n_words"]
    found = by_id(OPERATORS["simhash"](odd, items))
    assert {found[i]["component_id"] for i in (2, 3, 5)} == {2} and found[2]["fp"] == 0
    assert found[1]["component_id"] == 1
    found = by_id(OPERATORS["mixing"](odd, items))
    assert found[2]["n_tokens"] == found[3]["n_tokens"] == found[5]["n_tokens"] == 1
    found = by_id(OPERATORS["sentences"](odd, items))
    assert found[2]["text"] is None and found[3]["text"] == "" and found[1]["removed"] == []  # too short
    assert len(found[4]["text"]) < len(LONG)
    found = by_id(OPERATORS["pieces"](odd, items))
    assert found[2]["ids"] == [] and found[4]["decoded"] == LONG
    found = by_id(OPERATORS["tokens"](odd, items))
    assert (found[2]["n_bytes"], found[2]["n_tokens"]) == (0, 0)
    assert all(r["score"] == 0 for r in OPERATORS["toxicity unlabelled"](odd, items).collect())


def test_pipeline_on_odd_tables(spark, odd, empty, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert name == "pieces" or docs.columns == columns
            docs = corpus_pipeline.written(docs, "test")
        # of the two rows of 1 one stays; the row without an id is a copy of 7
        assert sorted((r["doc_id"] or -1) for r in docs.collect()) == ([1, 4, 7] if start is odd else [])


def numbered_words(k, n=60):
    return " ".join(f"w{(k * 7919 + i * 104729) % 99991}" for i in range(n))


def test_near_duplicates_leave_one_row_of_each_class(spark):
    a, b, c, d = map(numbered_words, range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, c), (None, c), (3, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, a), (None, b), (1, c), (1, d), (3, None)]))


@pytest.mark.parametrize("after", ["train", "label", "fingerprints", "links", "contaminated"])
def test_a_worker_forgets_the_pieces_when_another_operator_runs(spark, items, monkeypatch, after):
    some = spark.createDataFrame([(1, "some words of a text", "en", 5)], "doc_id long, text string, lang string, fp long")
    functions = []
    with monkeypatch.context() as m:
        plain = type(some).mapInArrow
        m.setattr(type(some), "mapInArrow", lambda self, f, kinds: functions.append(f) or plain(self, f, kinds))
        encode_pieces(some, PIECES)
        model = language_id.train(some, F.lit(True))
        language_id.label_spans(some, model)
        simhash.fingerprints(some)
        simhash.links(some.select("fp"))
        decontaminate.contaminated(some, items)
    task = dict(zip(["encode", "train", "label", "fingerprints", "links", "contaminated"], functions, strict=True))
    rows = pa.RecordBatch.from_pydict({"id": [1], "text": ["some words"]})
    assert sum(b.num_rows for b in task["encode"](iter([rows]))) == 1
    held = [o for o in gc.get_objects() if isinstance(o, PieceModel)]
    assert any("▁words" in o._words for o in held)
    gone = [weakref.ref(o) for o in held]
    del held
    list(task[after](iter([])))
    gc.collect()
    assert not any(r() for r in gone)


def test_benchmark_blocks_give_what_one_block_gives(spark):
    a, b, c, d, e = map(numbered_words, range(5))
    rows = [(None, a), (None, b), (None, f"{c} {d}"), (1, e), (1, f"x {a} y {c}"), (2, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    items = spark.createDataFrame([(8, a), (7, c), (None, d), (9, "")], "item_id long, text string")
    for keep in (["place", "text"], ["place"], None):
        whole, parts = (decontaminate.contaminated(docs, items, keep=keep, block_bytes=n) for n in (1 << 20, 1))
        assert parts.dtypes == whole.dtypes
        key = lambda r: repr(tuple(r))
        assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key)
        if keep:
            assert {r["place"]: r["items"] for r in parts.collect()} == {0: [8], 1: [], 2: [None, 7], 3: [], 4: [7, 8], 5: []}


def test_passage_without_marks_is_found_at_any_offset(spark):
    passages = [numbered_words(k) for k in range(1, 30)]
    lead = lambda k, n: " ".join(f"l{k}x{i}" for i in range(n))
    texts = [t for k, p in enumerate(passages) for t in (f"{lead(2 * k, 5)} {p} {lead(-k, 9)}", f"{lead(2 * k + 1, 6 + k % 13)} {p}")]
    found = sentence_spans.drop_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    rows = {r["doc_id"]: r for r in found.collect()}
    for k, p in enumerate(passages):
        assert rows[2 * k]["text"] == texts[2 * k]
        gone = [texts[2 * k + 1][a:b].split() for a, b in rows[2 * k + 1]["removed"]]
        assert all(set(g) <= set(p.split()) for g in gone) and sum(map(len, gone)) >= 30


def test_repeated_rows_and_rows_without_an_id_keep_one_place(spark, tmp_path):
    passage = ". ".join(" ".join(f"p{k}w{i}" for i in range(8)) for k in range(6)) + "."
    rows = [(7, passage), (7, passage), (None, passage), (None, passage), (8, f"Own words here. {passage}"), (3, None), (None, numbered_words(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    for df in (docs, spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "docs")).filter("true OR doc_id > 1")):
        found = sentence_spans.drop_repeated_spans(df).collect()
        assert sorted(((r["doc_id"] or 0, r["text"]) for r in found), key=repr) == sorted(
            [(7, passage), (7, ""), (0, ""), (0, ""), (8, "Own words here. "), (3, None), (0, numbered_words(1))], key=repr
        )
