"""Each stage against brute force on its own input, and run() against the chain of stages."""

import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as C
from brindle.llm import byte_bpe, quality_rules
from tests.llm.test_simhash_dedup import brute_components, brute_fingerprint
from tests.llm.test_winnowing import brute as brute_hits


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f.__name__ for _, f in C.STAGES] == ["quality", "near_duplicates", "decontamination", "token_ids"]
    good = C.quality(spark, docs, sf_dir).collect()
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    assert Counter(r.doc_id for r in good) == Counter(kept) and 0 < len(good) < docs.count()

    frame = spark.createDataFrame(good, docs.schema)
    single = C.near_duplicates(spark, frame, sf_dir).collect()
    comp = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in good])
    assert {r.doc_id for r in single} == set(comp) and len(single) == len(set(comp))

    frame = spark.createDataFrame(single, docs.schema)
    clean = C.decontamination(spark, frame, sf_dir).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in single], items) if r[5]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - hits

    frame = spark.createDataFrame(clean, docs.schema)
    assert frame.columns == docs.columns
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        special_tokens={},
    )
    want = {r.doc_id: library.encode_ordinary(r.text) for r in clean}
    assert {r.doc_id: r.ids for r in C.token_ids(spark, frame, sf_dir).collect()} == want
    assert {r.doc_id: r.ids for r in C.run(spark, sf_dir).collect()} == want


def edge_tables(spark, sf_dir, path, rows=None):
    """Documents with nulls, repeated rows and ids, very long texts and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    real = docs.collect() if rows is None else rows
    given = [tuple(r) for r in real]
    if given:
        d = given[0]
        long = " ".join(f"{a} {i % 977}x{i % 89}" for i, a in enumerate(" ".join(r.text for r in real[:60]).split()))
        given += [d, d, (None, *given[1][1:]), (given[2][0], *given[3][1:]), (None, None, None, None, None), (90_001, "", "en", None, 0)]
        given += [(90_002, None, None, "src1", 0), (90_003, long, None, None, len(long)), (90_004, "a " * 60, "en", "src1", 120)]
    more = [(*r, "x", 1, 2, "y", True) for r in given]
    frame = spark.createDataFrame(more, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in docs.schema)}, row string, rid int, fp long, word string, kept boolean")
    frame.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0 if rows == [] else 10**9).write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_edges_go_through_every_stage(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/edges"
    docs = edge_tables(spark, sf_dir, path)
    held, rows = docs, docs.collect()
    good = C.quality(spark, held, path)
    assert good.columns == docs.columns
    kept_ids = {r.doc_id for r in good.collect()}
    kept = Counter((r.doc_id, r.n_words) for r in quality_rules.quality_rules(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in good.collect()) == Counter(k for k, n in kept.elements())
    assert None in kept_ids

    good = spark.createDataFrame(good.collect(), docs.schema)
    single = C.near_duplicates(spark, good, path).collect()
    prints = [brute_fingerprint(r.text) for r in good.collect()]
    group = brute_components(list(enumerate(prints)))
    by_print = dict(zip(prints, group, strict=True))
    members = {}
    for r, g in zip(good.collect(), group, strict=True):
        members.setdefault(g, []).append(r)
    assert len(single) == len(members) and {by_print[brute_fingerprint(r.text)] for r in single} == set(members)
    for r in single:  # the least id of its group, none only where no member has one
        ids = [m.doc_id for m in members[by_print[brute_fingerprint(r.text)]] if m.doc_id is not None]
        assert r.doc_id == min(ids, default=None)

    whole = C.run(spark, path).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    hits = Counter(r[0] for r in brute_hits([(r.doc_id, r.text) for r in single], items).elements() if r[5])
    assert Counter(r.doc_id for r in whole) == Counter(r.doc_id for r in single) - hits
    texts = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in single}  # one id has two texts
    assert {(r.doc_id, r.decoded_sha256) for r in whole} <= texts
    assert len(rows) > len(whole) > 50


def test_empty_tables_go_through_every_stage(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/none"
    docs = edge_tables(spark, sf_dir, path, [])
    for _, stage in C.STAGES[:3]:
        made = stage(spark, docs, path)
        assert made.columns == docs.columns and made.collect() == []
    assert C.run(spark, path).collect() == []
