"""Each operator on documents against brute force, with nulls, repeats, empty tables, long texts and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from ringfold.llm import idfiles, langid, licenses, mixing, packing, pii, quality, repeats, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, bucket int"
BASE = " ".join(f"word{k % 37} thing{k % 11} of{k}" for k in range(40))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE + " tail", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "one", "de", "b"),
    (6, "été à la maison " * 30, "fr", "b"), (7, "\n \t", "fr", None), (8, "line here\nline here\nother #$%\n" * 9, "en", "c"),
    (9, BASE, "de", "c"), (9, BASE, "de", "c"), (9, "another text for the same id " * 12, "de", "c"), (None, BASE + " x", "en", "a"), (None, None, None, None),
    (10, "long " + " ".join(f"l{k % 5000}" for k in range(30_000)), "en", "d"), (11, "Reach me at +1 (372) 555-7739 or a.b1@mail.example.com, 4550997810720808 on 2024-02-29.", "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "f", 3, 7) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_repeats_match_brute_force(docs, empty):
    got = key((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in repeats.remove_repeats(docs).collect())
    place = lambda r: (r[0] is None, r[0] or 0, xxh(r[1]))
    seen, result = {}, {}
    for r in sorted({(r[0], r[1]) for r in ROWS}, key=place):
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.setdefault(k, (place(r), i))
        result[r] = (r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    assert got == key(result[r[:2]] for r in ROWS)
    assert repeats.remove_repeats(empty).count() == 0


def xxh(text):
    """Low 32 bits of the hash that ranks texts of one id."""
    return (xxhash.xxh64_intdigest(text.encode(), seed=42) if text is not None else 42) & 0xFFFFFFFF


def test_repeats_are_maximal_runs(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    d = spark.createDataFrame([(1, "x " + passage + " y"), (2, "a b " + passage + " c " + passage)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(d).collect()}
    assert [tuple(s) for s in rows[2].repeats] == [(2, 32), (33, 63)] and rows[1].repeats == [] and rows[2].kept == "a b c"


def brute_print(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    kinds = sorted(root)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {p: find(p) for p in kinds}


def test_simhash_matches_brute_force(docs, empty):
    got = key((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_print(r[1]) for r in ROWS]
    root = brute_components(set(prints))
    first = {}
    for r, p in zip(ROWS, prints, strict=True):
        if r[0] is not None:
            first[root[p]] = min(first.get(root[p], r[0]), r[0])
    assert got == key((r[0], f"{p:016x}", first.get(root[p])) for r, p in zip(ROWS, prints, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_simhash_links_near_prints_whole(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    prints = set(base)
    for p in base:
        chain = p
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                chain ^= 1 << int(b)
            prints.add(chain)
    hub = base[0]
    prints |= {hub ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    d = spark.createDataFrame([(p,) for p in signed], "fp long")
    from ringfold.llm.components import components

    for block in (2048, 16):
        got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.print_links(d, block)).collect()}
        want, same = brute_components(prints), {}
        for p in prints:
            assert same.setdefault(want[p], got.get(p, p)) == got.get(p, p)
        assert len(set(same.values())) == len(set(want.values()))


def test_chain_budgets_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x = 0
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x |= 1 << int(b)
        assert any(simhash.chained(np.array([x], np.uint64), np.array([i]))[0] for i in range(8))


def test_keep_one_keeps_one_of_each(docs):
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted({(r[0] is None, r[0] or 0) for r in [ROWS[0], ROWS[2], ROWS[4], ROWS[5], ROWS[7], ROWS[10], ROWS[13], ROWS[14]]} | ({(False, 2)} if brute_components({brute_print(r[1]) for r in ROWS})[brute_print(ROWS[1][1])] != brute_components({brute_print(r[1]) for r in ROWS})[brute_print(BASE)] else set()) | ({(True, 0)} if len({brute_components({brute_print(r[1]) for r in ROWS})[brute_print(t)] for t in (BASE, BASE + " x")}) == 2 and brute_components({brute_print(r[1]) for r in ROWS})[brute_print(BASE + " x")] != brute_components({brute_print(r[1]) for r in ROWS})[brute_print(BASE + " tail")] else set()))
    assert kept[0].asDict().keys() == dict.fromkeys(c.split()[0] for c in SCHEMA.split(", ")).keys()


def test_quality_counts_and_rare_ngrams(docs, empty):
    got = key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = []
    for doc_id, text, *_ in ROWS:
        w, t = words(text), text or ""
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, lines = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                lines += line in seen
                seen.add(line)
        want.append((doc_id, len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), lines, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    assert got == key(want)
    whole = key(tuple(r) for r in quality.judge(docs).collect())
    for most in (0, 40, 900):
        assert whole == key(tuple(r) for r in quality.judge(docs, model_rows=most).collect())
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def plain_fold(text):
    t = "".join("0" if c.isascii() and c.isdigit() else " " if ord(c) <= 32 or c in "\xa0\u3000" else c for c in (text or "").lower())
    return re.sub(" +", " ", t)


class PlainModel:
    """Interpolated modified Kneser-Ney of order 4 in dictionaries; ``kinds`` is the alphabet with one more for the unseen."""

    def __init__(self, texts, kinds):
        padded = ["\x02\x02\x02" + t for t in texts]
        self.kinds, self.counts = kinds, {4: Counter(t[i - 3 : i + 1] for t in padded for i in range(3, len(t)))}
        for order in (3, 2, 1):
            c = Counter()
            for gram, n in self.counts[order + 1].items():
                c[gram[1:]] += n if gram[1] == "\x02" else 1
            self.counts[order] = c
        self.d, self.total, self.taken = {}, {}, {}
        for order, c in self.counts.items():
            t = Counter(c.values())
            y = t[1] / max(t[1] + 2 * t[2], 1)
            self.d[order] = [0.0] + [min(max(k - (k + 1) * y * t[k + 1] / t[k], 0.05), k - 0.05) if t[1] and t[k] and t[k + 1] else k / 2 for k in (1, 2, 3)]
            self.total[order], self.taken[order] = Counter(), Counter()
            for gram, n in c.items():
                self.total[order][gram[:-1]] += n
                self.taken[order][gram[:-1]] += self.d[order][min(n, 3)]

    def p(self, gram):
        lower = self.p(gram[1:]) if len(gram) > 1 else 1 / self.kinds
        order, context = len(gram), gram[:-1]
        if not self.total[order][context]:
            return lower
        n = self.counts[order][gram]
        return (n - self.d[order][min(n, 3)] + self.taken[order][context] * lower) / self.total[order][context]


def test_perplexity_is_that_of_a_plain_model(docs):
    folds = {}
    for _, text, lang, *_ in ROWS:
        folds.setdefault((lang, (xxhash.xxh64_intdigest(text, 42) if text is not None else 42) & 1), []).append(plain_fold(text))
    got = {}
    for r in quality.judge(docs).collect():
        got.setdefault((r.doc_id, r.n_words), set()).add(round(r.perplexity, 5))
    assert {lang for lang, _ in folds} == {"en", "de", "fr", None} and len(folds) > 4
    for doc_id, text, lang, *_ in ROWS:
        fold = (xxhash.xxh64_intdigest(text, 42) if text is not None else 42) & 1
        kinds = len({c for f in (0, 1) for t in folds.get((lang, f), []) for c in t}) + 1
        model, t = PlainModel(folds.get((lang, 1 - fold), []), kinds), "\x02\x02\x02" + plain_fold(text)
        logs = [np.log(model.p(t[i - 3 : i + 1])) for i in range(3, len(t))]
        want = np.exp(-np.mean(logs)) if logs else 1.0
        assert any(abs(x - want) < 1e-4 * want for x in got[doc_id, len(words(text))])


def test_plain_model_sums_to_one():
    texts = [plain_fold(r[1]) for r in ROWS if r[1] and r[2] == "en"]
    kinds = {c for t in texts for c in t}
    model = PlainModel(texts, len(kinds) + 1)
    for context in ("wor", "thi", "zzz", "\x02\x02w"):
        assert abs(sum(model.p(context + c) for c in [*kinds, "?unseen"[0]]) - 1) < 1e-9


def test_long_texts_are_counted_in_chunks(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"some words {k} and more of them, " * (40 + 3 * k), "x") for k in range(9)], "doc_id long, text string, lang string")
    whole = key(tuple(r) for r in quality.judge(d).collect())
    rows = d.select(quality.F.lit(1).alias("g"), "doc_id", quality.F.lit(0).alias("tie"), quality.bytes_of("text").alias("body"))
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    one = [np.concatenate(x) for x in zip(*quality._grams_of(batch), strict=True)]
    monkeypatch.setattr(quality, "_CHUNK", 101)
    many = [np.concatenate(x) for x in zip(*quality._grams_of(batch), strict=True)]
    assert all((a == b).all() for a, b in zip(one, many, strict=True)) and len(whole) == 9


def test_perplexity_rejects_noise_and_keeps_prose(spark):
    rng = np.random.default_rng(2)
    syllables = ["ta", "ri", "mo", "len", "sa", "ko", "ne", "vi"]
    prose = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(150)) for _ in range(120)]
    noise = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 300))
    noise = " ".join(noise[k : k + 3] for k in range(0, 300, 3))
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*prose, noise])], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.judge(d).collect()}
    assert all(rows[k].kept for k in range(120)) and not rows[120].base_failed and not rows[120].kept


def test_perplexity_band_follows_the_spread(spark):
    rng = np.random.default_rng(6)
    syllables = ["ta", "ri", "mo", "len", "sa", "ko", "ne", "vi"]
    prose = [["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(300)] for _ in range(164)]
    for words_ in prose[160:]:
        for at in rng.choice(300, 18, replace=False):
            words_[at] = "".join(rng.choice(list("bdfghjpqwxz"), 5))
    d = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(prose)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.judge(d).collect()}
    lp = np.log([rows[k].perplexity for k in range(164)])
    half = np.log(rows[0].upper / rows[0].lower) / 2
    sigma = 1.4826 * np.median(np.abs(lp - np.median(lp)))
    assert abs(half - quality.WIDTH * sigma) < quality.WIDTH * 1.5 * quality.STEP and half < 0.2
    assert all(lp[k] - np.median(lp) < 0.4 for k in range(164))
    assert all(rows[k].kept for k in range(160)) and not any(rows[k].kept or rows[k].base_failed for k in range(160, 164))
    low = quality._bands([Row(g=7, bucket=b, n=n) for b, n in ((1000, 1), (1480, 40), (1500, 90), (1520, 40), (1700, 2))], quality.WIDTH, quality.LEAST)
    assert 1.0 < low[0][1] and low[0][2] < 1.7


def test_pseudonyms_keep_format_and_link():
    text = "Card 4550 9970 1234 5675? 4550997810720808, 4550-9978-1072-0808; on 2024-02-29 and 29.02.2024 from 10.1.2.3, Version 2.0."
    out, found = pii.pseudonymised(text.encode(), b"k")
    out = out.decode()
    kinds = [k for k, _, _ in found]
    assert kinds.count("card") >= 2 and kinds.count("date") == 2 and kinds.count("ipv4") == 1 and "Version 2.0." in out
    a = out.split("? ")[1].split(",")[0]
    assert pii.luhn(a) and a != "4550997810720808" and f"{a[:4]}-{a[4:8]}-{a[8:12]}-{a[12:]}" in out
    assert pii.pseudonymised(text.encode(), b"other")[0].decode() != out
    assert sorted(pii.permute(i, 999, b"k", "t") for i in range(999)) == list(range(999))
    assert all(pii.permute(pii.permute(i, 73, b"k", "t"), 73, b"k", "t", inverse=True) == i for i in range(73))


def test_pseudonyms_on_a_table(docs, empty):
    rows = pii.pseudonymise(docs, found="found").collect()
    assert len(rows) == len(ROWS) and sum(r.text is None for r in rows) == 2
    touched = next(r for r in rows if r.doc_id == 11)
    assert sorted(x.kind for x in touched.found) == ["card", "date", "email", "phone"] and "4550997810720808" not in touched.text and "mail.example" not in touched.text
    assert all(r.text == o[1] for r in rows for o in ROWS if r.doc_id == o[0] and r.doc_id in (1, 2, 5, 6, 8))
    assert pii.pseudonymise(empty).columns == empty.columns


def library_ids(name, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_id_files_round_trip(spark, docs, empty, tmp_path):
    idfiles.write_ids(docs, f"{tmp_path}/ids")
    rows = sorted(idfiles.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 10, 11, None, None]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = Counter((r[0], library_ids("byte_bpe_50k.json", r[1], 2).tobytes()) for r in ROWS)
    assert want == Counter((r.doc_id, bytes(r.ids)) for r in rows)
    idfiles.write_ids(empty, f"{tmp_path}/none")
    assert idfiles.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, codes = idfiles.encode_ranks(x)
        assert len(control) == -(-n // 4)
        assert (idfiles.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(codes, np.uint8), n) == x).all()
    ids, lengths, values = idfiles.read_shard(idfiles.write_shard(np.array([5, 7]), np.array([2, 3]), np.arange(5, dtype=np.uint32) * 300))
    assert ids.tolist() == [5, 7] and lengths.tolist() == [2, 3] and values.tolist() == [0, 300, 600, 900, 1200]


def test_encoder_is_the_library(spark):
    from ringfold.llm.tokens import Encoder

    texts = [r[1] or "" for r in ROWS] + ["it's I'LL don't\n\n x  y\t z é a ́b  c  d 　e 漢字 👍🏽 <|endoftext|> a  \n b ", "12345 1 22 ½ ² ª º µ ß ẞ İI ÿ ×÷ don’t \x00 a\x85 b", " lead trail ", "a \n", "\na\n b"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for kept in (100_000, 50):
            ids, counts = Encoder(name, kept).encode(buf, off)
            want = [library_ids(name, t, 0)[:-1] for t in texts]
            assert counts.tolist() == [len(w) for w in want] and (ids == np.concatenate(want)).all()


def test_added_tokens_are_the_librarys(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from ringfold.llm.tokens import Encoder

    texts = ["a b <|endoftext|> c", "<|startoftext|>", "x<|endoftext|>y it's\n<|endoftext|>\n z", "e<|startoftext|>\u0301 漢<|endoftext|>字", "<|ENDOFTEXT|> <|endoftext |> <|endof text|>", "é <|endoftext|><|startoftext|> <|endoftext|>  b ", "plain"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    want = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        want[name] = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        for kept in (100_000, 5):
            ids, counts = Encoder(name, kept, added=True).encode(buf, off)
            assert counts.tolist() == [len(w) for w in want[name]] and ids.tolist() == sum(want[name], [])
    assert want["byte_bpe_50k.json"][0] == [64, 275, 220, 50256, 269]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idfiles.write_ids(d, f"{tmp_path}/ids")
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in idfiles.read_ids(spark, f"{tmp_path}/ids").collect()}
    assert got == {k: [*w, 2] for k, w in enumerate(want["byte_bpe_50k.json"])}
    assert {r.doc_id: r.length for r in packing.pack(d).collect()} == {k: len(w) + 1 for k, w in enumerate(want["word_bpe_49k.json"])}


def test_packing_is_whole_and_tight(docs, empty):
    rows = packing.pack(docs).collect()
    ids = Counter()
    for r in ROWS:
        t = library_ids("word_bpe_49k.json", r[1], 1)
        for p, s in enumerate(range(0, len(t), 4096)):
            ids[r[0], p, s, len(t[s : s + 4096]), zlib.crc32(t[s : s + 4096].tobytes())] += 1
    assert ids == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 1
    assert packing.pack(empty).count() == 0


def test_vector_best_fit_keeps_every_capacity():
    lengths = np.random.default_rng(4).integers(1, 1500, 600)
    for rule in ("norm", "dot"):
        cap = packing.Capacity(4096, 6, 4e6, rule)
        place, offset = packing.best_fit(lengths, cap)
        for b in np.unique(place):
            mine = np.flatnonzero(place == b)
            assert lengths[mine].sum() <= 4096 and len(mine) <= 6 and (lengths[mine].astype(float) ** 2).sum() <= 4e6
            assert sorted(offset[mine]) == np.concatenate([[0], np.cumsum(lengths[mine[np.argsort(offset[mine])]])])[:-1].tolist()
    with pytest.raises(ValueError):
        packing.Capacity(0)


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return goal | share
        for s in above:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= above
    return goal


def test_mixture_meets_targets(docs, empty, spark):
    from pyspark.sql import functions as F

    plain = docs.drop("size")
    sized = mixing.sizes(plain)

    def taken_of(sized):
        return mixing.taken_words(sized, mixing.plan(sized, mixing.source_targets(sized)))

    rows = taken_of(sized).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    goal = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = taken_of(sized).collect()
    assert key(map(tuple, rows)) == key(map(tuple, again))
    got = Counter()
    for r in mixing.mixture(plain).collect():
        got[r.source] += len(words(r.text))
    assert all(abs(got[s] - goal[s]) <= 1 for s in sizes)
    assert mixing.mixture(empty).count() == 0
    none = empty.select("doc_id", "source", F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("tie"))
    assert taken_of(none).count() == 0


def test_mixture_cuts_where_a_sorted_list_would(spark, monkeypatch):
    """Against a plain list sorted by position; with copies of one row, which get the same number of words; and with sources beyond the broadcast bound."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 9))) + f" d{k}", None if k % 5 == 0 else f"s{k % 3}") for k in range(300)] + [(777, "many copies of one text", "s9")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sized = mixing.sizes(docs).withColumn("spot", mixing._spot(17))
    targets = {r.source: r for r in mixing.source_targets(sized, weights=(3.0, 1.0, 2.0, 0.4), budget=1.3).collect()}
    for most in (mixing.SOURCES, 0):
        monkeypatch.setattr(mixing, "SOURCES", most)
        got = mixing.taken_words(sized, mixing.plan(sized, mixing.source_targets(sized, weights=(3.0, 1.0, 2.0, 0.4), budget=1.3))).collect()
        for source, goal in targets.items():
            mine = sorted((r.spot, r.size, r.taken) for r in got if r.source == source)
            whole, rest = divmod(round(goal.target), goal.source_size)
            at = 0
            while at < len(mine):
                alike = [r for r in mine if r[0] == mine[at][0]]
                extra = min(alike[0][1], rest // len(alike))
                assert all(r[2] == whole * r[1] + extra for r in alike)
                rest = max(0, rest - sum(r[1] for r in alike))
                at += len(alike)


def test_language_on_held_out_rows(spark, empty):
    rng = np.random.default_rng(8)
    parts = {"aa": ["ta", "ri", "mo"], "bb": ["xu", "qe", "zy"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(40)), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", None), (None, "tarimo mota", "aa"), (903, "xuqezy " * 5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train(d, langid.learnable(), sample=60, windows=6, size=32)
    found = {r.doc_id: r for r in langid.identify(d, network).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 10 and np.mean([found[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert [found[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and found[None].lang_pred == "aa" and found[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.train(empty, langid.learnable()) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(d, None).collect()} == {"und"}


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=4)
    net.weights = [w.astype(np.float64) for w in net.weights]
    codes, label = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.loss_gradient(codes, label)
    for w, g in zip(net.weights, grads, strict=True):
        at = (98, 3) if w.shape[0] == 256 else tuple(0 for _ in w.shape)
        was = w[at]
        w[at] = was + 1e-5
        up = net.loss_gradient(codes, label)[0]
        w[at] = was - 1e-5
        down = net.loss_gradient(codes, label)[0]
        w[at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_licences(spark, empty):
    rows = [
        (1, "Copyright (c) 2020 Foo Bar. All rights reserved.\n\n" + licenses._MIT.replace("License", "LICENCE")), (2, "x\n// Released under the MIT licence.\nReleased under the MIT License.\n"), (3, None), (4, ""),
        (5, licenses._BSD_HEAD.format(n=3) + licenses._BSD_THIRD + "(c) 2011 X\n" + licenses._BSD_TAIL.replace("HOLDERS", "OWNERS")), (2, "x\n// Released under the MIT licence.\nReleased under the MIT License.\n"), (None, "Licensed under CC BY-NC 4.0."), (6, "a licence for nothing"),
    ]
    got = key((r.doc_id, r.licence, r.n_notices, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == key([(1, "MIT", 0, ""), (2, None, 2, "MIT"), (2, None, 2, "MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, "BSD-3-Clause", 0, ""), (6, None, 0, ""), (None, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0")])
    assert licenses.scan(empty).count() == 0
    assert all("licen" in t.lower() for _, t in licenses.known_texts())


def test_licences_without_their_heading(spark):
    mit, isc = (t.split("\n", 1)[1] for t in (licenses._MIT, licenses._ISC))
    bsd2, bsd3 = ((licenses._BSD_HEAD + third + licenses._BSD_TAIL).split("\n", 1)[1] for third in ("", licenses._BSD_THIRD))
    texts = [("MIT", mit), ("ISC", isc), ("BSD-2-Clause", bsd2), ("BSD-3-Clause", bsd3)]
    rows = [(k, "Copyright (c) 2021, A. B.\nAll rights reserved.\n\n" + text) for k, (_, text) in enumerate(texts)]
    rows += [(10 + k, f"prose here\n# released under the CC {x} 4.0.\nmore") for k, x in enumerate(("BY", "BY-SA", "BY-NC", "BY-ND"))] + [(20, "with permission of the editor, cc: all")]
    found = {r.doc_id: (r.licence, r.n_notices, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k][0] for k in range(4)] == [spdx for spdx, _ in texts]
    assert [found[10 + k] for k in range(4)] == [(None, 1, f"CC-{x}-4.0") for x in ("BY", "BY-SA", "BY-NC", "BY-ND")]
    assert found[20] == (None, 0, "")
    assert all(re.search(licenses.GATE, t) for _, t in licenses.known_texts() + licenses.further_texts())


def test_mixture_stage_takes_clashing_columns(spark, docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    plain = docs.select("doc_id", "text", "lang", "source")
    clashing = docs.select("doc_id", "text", "lang", "source", "size", *[F.concat(F.lit(c), F.lit("!")).alias(c) for c in ("tie", "target", "source_size", "taken", "__whole", "__Extra", "a.b")])
    out = corpus_pipeline.mix(spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert key(r[:4] for r in rows) == key(map(tuple, corpus_pipeline.mix(spark, plain, "").collect()))
    assert rows and all(tuple(r[4:]) == (3, "tie!", "target!", "source_size!", "taken!", "__whole!", "__Extra!", "a.b!") for r in rows)


def test_phone_numbers_link_however_they_are_written():
    def of(text):
        return pii.pseudonymised(text.encode(), b"k")[0].decode()

    def digits(text):
        return re.sub("[^0-9]", "", text)

    for alike in (["+49 171 1234 5678", "+4917112345678", "+49-171-1234-5678"], ["+1 (372) 555-7739", "(372) 555-7739", "372-555-7739", "+13725557739"], ["+420 601 123 456", "+420601123456"]):
        made = [digits(of(x)) for x in alike]
        national = {x[-len(digits(min(alike, key=len))):] for x in made}
        assert len(national) == 1 and all(of(x) != x and re.sub("[0-9]", "0", of(x)) == re.sub("[0-9]", "0", x) for x in alike)
    assert of("+4917112345678").startswith("+49") and of("+420601123456").startswith("+420") and of("+79161234567").startswith("+7")
    rng = np.random.default_rng(8)
    for _ in range(200):
        number = f"{rng.integers(200, 1000)}-{rng.integers(200, 1000)}-{rng.integers(0, 10000):04d}"
        assert of(number)[0] in "23456789" and of(number)[4] in "23456789"
    assert of("155-155-0000")[0] in "01" or of("155-155-0000")[4] in "01"


def plain_feistel(value, size, key, tweak):
    """The keyed permutation again, on bit strings."""
    bits = (size - 1).bit_length()
    half = max(1, (bits + 1) // 2)
    person = hashlib.blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()
    while True:
        text = format(value, f"0{2 * half}b")
        left, right = text[:half], text[half:]
        for r in range(8):
            message = bytes([r]) + int(right, 2).to_bytes((half + 7) // 8, "big")
            drawn = int.from_bytes(hashlib.blake2b(message, digest_size=(half + 7) // 8, key=key, person=person).digest(), "big") % (1 << half)
            left, right = right, format(int(left, 2) ^ drawn, f"0{half}b")
        value = int(left + right, 2)
        if value < size:
            return value


def test_permutation_is_a_feistel_network_and_a_bijection():
    for size in (2, 7, 100, 1000):
        made = [pii.permute(x, size, b"k", "t") for x in range(size)]
        assert sorted(made) == list(range(size)) and made == [plain_feistel(x, size, b"k", "t") for x in range(size)]
        assert [pii.permute(x, size, b"k", "t", inverse=True) for x in made] == list(range(size))
    assert pii.permute(123456789, 10**9, b"k", "t") == plain_feistel(123456789, 10**9, b"k", "t")


def test_pseudonym_query_against_its_parts(spark, docs):
    """Numbers found by the written forms alone, permuted by the plain network; the session's key is taken."""
    rows = [(1, "card 4550997810720808 and 10.1.2.3"), (2, None), (3, "on 2024-02-29, 10.1.2.3 again"), (3, "on 2024-02-29, 10.1.2.3 again"), (4, "")]
    d = spark.createDataFrame([(*r, 5, "y", "z") for r in rows], "doc_id long, text string, found long, __body string, c1 string")
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        got = {(r.doc_id, r.text) for r in pii.pseudonymise(d).collect()}
        assert pii.pseudonymise(d).columns == d.columns and pii.pseudonymise(d).where("found = 5 AND __body = 'y' AND c1 = 'z'").count() == 5
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    address = ".".join(map(str, plain_feistel(0x0A010203, 1 << 32, b"secret", "ipv4").to_bytes(4, "big")))
    body = str(plain_feistel(455099781072080, 10**15, b"secret", "card15")).zfill(15)
    card = next(body + c for c in "0123456789" if not sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(body + c))) % 10)
    first = pii._FIRST_DAY
    day = pii.datetime.date.fromordinal(first + plain_feistel(pii.datetime.date(2024, 2, 29).toordinal() - first, pii._LAST_DAY - first + 1, b"secret", "date"))
    assert got == {(1, f"card {card} and {address}"), (2, None), (3, f"on {day}, {address} again"), (4, "")}


def test_licences_by_digest_alone(spark):
    """Long licences are known by digest: every file of them that is at hand is found, also with other case, spacing and copyright lines."""
    import os

    known = {spdx for spdx, _ in licenses._WHOLE}
    assert {"GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "Apache-2.0"} <= known
    files = {"GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only"}
    at = [(spdx, f"/usr/share/common-licenses/{f}") for f, spdx in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    if not at:
        pytest.skip("no licence files here")
    rows = []
    for k, (spdx, path) in enumerate(at):
        text = open(path).read()
        rows += [(10 * k, text, spdx), (10 * k + 1, "Copyright (c) 2020 A. Body\n" + text.upper().replace("  ", "\t "), spdx), (10 * k + 2, text + " and more", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = {r.doc_id: r.licence for r in licenses.scan(d).collect()}
    assert got == {k: spdx for k, _, spdx in rows}


def test_best_fit_takes_the_best_of_all_that_fit():
    """Every choice, replayed one by one: it fits, no other sequence leaves a smaller norm (or a larger product), and a new one is opened only where none fits."""
    lengths = np.random.default_rng(9).integers(1, 900, 700)
    for cap in (packing.Capacity.whole(2048), packing.Capacity(2048, 5, 1.5e6, "norm", (1.0, 0.5, 2.0)), packing.Capacity(2048, 5, 1.5e6, "dot")):
        limits = (cap.tokens, cap.pieces, cap.cost)
        place, _ = packing.best_fit(lengths, cap)
        demand = [(int(n), 1, float(n) ** 2) for n in lengths]
        order = sorted(range(len(lengths)), key=lambda i: (-sum(w * x / m for w, x, m in zip(cap.weights, demand[i], limits, strict=True)), i))
        left, used = {}, set()
        for i in order:
            def score(b, i=i):
                if cap.rule == "norm":
                    return sum(w * ((r - x) / m) ** 2 for w, r, x, m in zip(cap.weights, left[b], demand[i], limits, strict=True))
                size = sum(w * (r / m) ** 2 for w, r, m in zip(cap.weights, left[b], limits, strict=True)) ** 0.5
                return -sum(w * x * r / m**2 for w, r, x, m in zip(cap.weights, left[b], demand[i], limits, strict=True)) / max(size, 1e-12)

            fits = [b for b in left if all(x <= r for x, r in zip(demand[i], left[b], strict=True))]
            b = place[i]
            if b in left:
                assert b in fits and score(b) <= min(map(score, fits)) + 1e-9
            else:
                assert not fits
                left[b] = limits
            left[b] = tuple(r - x for r, x in zip(left[b], demand[i], strict=True))


def test_prime_hashes_match_plain_sums(monkeypatch):
    """Word and window hashes modulo the prime, with words longer than a segment; and equal wherever the words stand."""
    from ringfold.llm import text

    monkeypatch.setattr(text, "_SEGMENT", 64)
    text._residues.cache_clear()
    p = (1 << 31) - 1
    raw = [b"one two  three " + b"x" * 200 + b" one two three four " * 9, b"", b"one two"]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, end, first = text.words(buf, off)
    h = text.prime_words(buf, start, end)
    base = 0x2F0B4C47
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        total = sum((c + 1) * pow(base, i, p) for i, c in enumerate(bytes(buf[a:b])))
        assert int(h[k]) == (total * 48271 + b - a) % p
    _, at = text.window_hashes(text.word_hashes(buf, start, end), first, 3)
    w = text.prime_windows(h, at, 3)
    for k, a in enumerate(at.tolist()):
        assert int(w[k]) == sum((int(h[a + i]) + 1) * pow(0x5DEECE6D, i, p) for i in range(3)) % p
    text._residues.cache_clear()


def test_repeats_with_many_buckets(docs):
    """Buckets by bytes of text don't change what is removed."""
    whole = key(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert whole == key(tuple(r) for r in repeats.remove_repeats(docs, bucket_bytes=20_000).collect())


def test_parts_hold_documents_in_order(spark, monkeypatch):
    """Ids that hold many rows, the largest id, and rows without one are dealt further; the files' order stays by id."""
    parts = idfiles.Parts([3, 7, 7, 7, 9], 2)
    rng = np.random.default_rng(5)
    ids, ties = rng.integers(0, 12, 3000), rng.integers(0, 1 << 63, 3000, dtype=np.uint64).astype(np.int64)
    none = rng.random(3000) < 0.2
    ids[none], ties[none] = 0, -ties[none] - 1
    p = parts.of(ids, ties)
    where = sorted((bool(n), int(i), int(t) if t >= 0 else -int(t) - 1, int(k)) for n, i, t, k in zip(none, ids, ties, p, strict=True))
    assert [w[3] for w in where] == sorted(p.tolist()) and len(set(p[(ids == 7) & ~none])) == 3 and len(set(p[none])) == 2
    monkeypatch.setattr(idfiles, "PART_BYTES", 500)
    rows = [(2**63 - 1, "the largest id")] + [(None, f"no id {k}") for k in range(40)] + [(5, f"same id, text {k}") for k in range(60)] + [(k, f"text {k}") for k in range(100, 140)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = idfiles.shared_path(spark, "ids")
    idfiles.write_ids(d, path)
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in idfiles.read_ids(spark, path).collect())
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[1] for g in got])])[:-1].tolist()
    assert [g[2] for g in got] == [5] * 60 + list(range(100, 140)) + [2**63 - 1] + [None] * 40
    assert spark.read.parquet(f"{path}/shards").select("part").distinct().count() > 8


def plain_probabilities(net, code):
    """Summed probabilities of one window's positions, one position and one gate at a time."""
    fx, fu, bx, bu, v, b = (w.astype(np.float64) for w in net.weights)
    n = fu.shape[0]

    def squash(x):
        return x / (1 + abs(x))

    def states(x, u, order):
        h, out = np.zeros(n), {}
        for t in order:
            a, s = x[code[t]], h @ u
            new, z = np.empty(n), np.empty(n)
            for k in range(n):
                z[k] = 0.5 + 0.5 * squash(a[k] + s[k])
                reset = 0.5 + 0.5 * squash(a[n + k] + s[n + k])
                new[k] = squash(a[2 * n + k] + reset * s[2 * n + k])
            h = z * h + (1 - z) * new
            out[t] = h
        return out

    ahead, back = states(fx, fu, range(len(code))), states(bx, bu, range(len(code) - 1, -1, -1))
    total = np.zeros(len(b))
    for t in range(len(code)):
        e = np.exp(np.concatenate([ahead[t], back[t]]) @ v + b)
        total += e / e.sum()
    return total


def test_prediction_reads_what_training_does(spark, monkeypatch):
    """States of both directions as training has them, and a table's predictions as a plain loop over positions gives them, padded windows and all."""
    rng = np.random.default_rng(12)
    net = langid.Network(["a", "b", "c"], hidden=5)
    codes = rng.integers(32, 127, (24, 6)).astype(np.uint8)
    for weights, backward in ((net.weights[:2], False), (net.weights[2:4], True)):
        layer = langid.Direction(*weights)
        assert np.allclose(layer.run(codes, backward)[0].transpose(0, 2, 1), layer.states(codes, None, backward), atol=1e-5)
    monkeypatch.setattr(langid, "WINDOW", 16)
    texts = ["short", "x" * 16, "a text of more windows than one, the last one padded", "été" * 40, None, "12 34"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    batch = d.select(langid.F.col("doc_id"), langid.F.lit(True).alias("lettered"), langid.bytes_of("text").alias("body")).toArrow()
    codes, lengths, text = langid._windows(*langid.buffers(batch.column("body")), 16)
    got = np.zeros((len(texts), 3))
    np.add.at(got, text, net.probabilities(codes, lengths))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        want = sum((plain_probabilities(net, list(raw[a : a + 16])) for a in range(0, len(raw), 16)), np.zeros(3))
        assert np.allclose(got[k], want, atol=1e-4)
    found = {r.doc_id: r for r in langid.identify(d, net).collect()}
    for k, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (found[k].lang_pred, found[k].score) == ("und", 0.0)
            continue
        size = langid.WINDOW if len(t.encode()) else 1
        want = sum((plain_probabilities(net, list(t.encode()[a : a + size])) for a in range(0, len(t.encode()), size)), np.zeros(3))
        assert found[k].lang_pred == net.labels[int(want.argmax())] and abs(found[k].score - want.max() / want.sum()) < 1e-4
