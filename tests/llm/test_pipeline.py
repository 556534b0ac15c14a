"""The pipeline's stages on a small table: decisions take effect, columns stay, and every step agrees with its operator's brute force."""

from collections import Counter

import corpus_pipeline
from ringfold.llm import pii, quality, simhash
from tests.conftest import SMALL


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, steps = docs.columns, {}
    source = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        steps[name] = (before, docs)
        if k < 4:
            assert docs.columns == names
    before, kept = steps["quality rules"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(before).where("kept").collect()}
    assert all(source[r.doc_id] == r for r in kept.collect())
    before, one = steps["near-duplicates"]
    prints = {r.doc_id: simhash.fingerprint_of(r.text.encode()) for r in before.collect()}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in one.collect()) == sorted({find(d) for d in ids})
    before, made = steps["pseudonyms"]
    assert {r.doc_id: r.text for r in made.collect()} == {r.doc_id: pii.pseudonymised(r.text.encode())[0].decode() for r in before.collect()}
    before, mixed = steps["mixture"]
    sizes = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.encode().split())
    assert all(taken[d] <= 2 * sizes[d] for d in taken) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 25
    before, packed = steps["packing"]
    rows = packed.collect()
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in rows if r.piece == 0)
    assert max(Counter({k: 0} | dict(_filled(rows))).values()) <= 4096


def _filled(rows):
    total = Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    return total


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_nulls_repeats_clashing_names_and_nothing(spark):
    """Each stage alone on a small table with every case that its module states; columns named like the operators' own come out as they went in."""
    prose = " ".join(f"word{k % 53} thing{k % 17} of{k}" for k in range(60))
    other = " ".join(f"sentence{k % 41} about{k % 19} matter{k}" for k in range(60))
    rows = [(1, prose, "en", "a"), (2, prose + " tail", "en", "a"), (2, prose + " tail", "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, other, "en", "b"), (None, None, None, None), (5, "few words", "de", "c"), (6, other + " 4550997810720808", "en", "c"), (7, "long " * 20_000, "en", "c")]
    names = ["__id", "__tie", "tie", "g", "body", "size", "taken", "target", "fp", "head", "c0", "found", "bucket", "__kept0", "a.b", "Doc"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(names))) for r in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name == "packing":
            assert sum(r.piece == 0 for r in got) == len(rows)
        else:
            assert out.columns == docs.columns and all(tuple(r[5:]) == tuple(range(len(names))) for r in got)
            assert all(r.n_chars == len(r.text or "") for r in got)
        if name == "quality rules":
            assert {r.doc_id for r in got} <= {1, 2, None, 6} and all(r.text for r in got)
        if name == "near-duplicates":
            assert sum(r.doc_id == 2 for r in got) <= 1 and sum(not (r.text or "").split() for r in got) == 1
        if name == "pseudonyms":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 2 and not any("4550997810720808" in (r.text or "") for r in got)
        if name == "mixture":
            assert all(sum(x.text is not None and x.text == r[1] for x in got) <= 2 * sum(x[1] == r[1] for x in rows) for r in rows if r[1])
        assert stage(spark, docs.limit(0), "").count() == 0
