"""Corpus queries against SQL where it can express them, and against brute force elsewhere."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from brindle.llm import near_dedup, packing, pii, quality, suffix_dedup
from brindle.llm.queries import ORACLE, QUERIES

from ..oracle import same_rows

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, QUERIES[name], ORACLE[name])


def test_every_operator_is_registered():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 11))


# ------------------------------------------------------------------ suffix arrays
@pytest.mark.parametrize("letters", [1, 2, 4, 200])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 60, 700])
def test_suffix_array_and_prefixes(n, letters):
    text = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    raw = text.tobytes()
    order = suffix_dedup.suffix_array(text)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])

    def shared(a, b):
        k = 0
        while k < 50 and max(a, b) + k < n and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert suffix_dedup.common_prefixes(text, order)[1:].tolist() == [shared(order[i - 1], order[i]) for i in range(1, n)]


def removed(docs: pd.DataFrame) -> dict:
    seen, out = set(), {}
    for doc_id, rows in docs.sort_values("doc_id", na_position="last").groupby("doc_id", dropna=False):
        new = set()
        for text in rows.text:
            raw = (text or "").encode()
            edge = np.zeros(len(raw) + 1, int)
            for p in range(len(raw) - 49):
                w = raw[p : p + 50]
                if w in seen:
                    edge[p] += 1
                    edge[p + 50] -= 1
                new.add(w)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        seen |= new
    return out


@pytest.mark.parametrize("least_split", [1, 64])
def test_repeats_match_brute_force(spark, sf_dir, least_split):
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_split=least_split).toPandas()
    want = removed(pd.read_parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want


@pytest.mark.parametrize("least_split", [1, 64])
def test_repeats_in_periodic_and_long_texts(spark, least_split):
    """least_split 1: all keys are split by their second key."""
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh"), 60))
    texts = ["a" * 300, "ab" * 200 + "a" * 80, "x" * 49, passage, "y" * 30 + passage + "z" * 30, passage[:50] + passage[:50], "é" * 70, "ü" + "é" * 40, "", passage * 900]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs), block_docs=3, least_split=least_split).toPandas()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == removed(docs)


# ------------------------------------------------------------------ near duplicates
def linked(docs: pd.DataFrame, width: int = 4) -> dict:
    sets, where = {}, defaultdict(list)
    for i, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        for s in sets[i]:
            where[s].append(i)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = defaultdict(int)
    for own in where.values():
        for pair in combinations(sorted(own), 2):
            shared[pair] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_components_match_brute_force(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = near_dedup.query(spark, sf_dir).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked(pd.read_parquet(f"{sf_dir}/documents.parquet"))
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_families_near_the_threshold(spark):
    """Chains of edited copies: what differs from the hub decides."""
    rng = np.random.default_rng(5)
    words, texts = [f"w{i}" for i in range(3000)], []
    for size in (60, 150):
        base = rng.choice(words, size).tolist()
        for _ in range(60):
            copy = list(base)
            for _ in range(int(rng.integers(0, 11)) * size // 150 + 1):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words[:50]))
            texts.append(" ".join(copy))
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = near_dedup.near_components(spark.createDataFrame(docs)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked(docs)


def test_words_that_follow_a_pattern_are_apart(spark):
    """A Thue-Morse word and its complement: equal under a hash of powers modulo 2^64, with no word in common."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    got = near_dedup.near_components(spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"{a} {b} x y z"), (5, f"{b} {a} x y z")], "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_a_large_family_needs_few_pairs(spark, monkeypatch):
    """Copies of one text with a few words changed, half of them beyond the threshold, and the text itself not among them: one
    pair with a hub a member, and of the 1,124,250 pairs of members one in a hundred is compared."""
    from brindle.llm.common import Scratch

    rng, base, texts = np.random.default_rng(11), [f"w{i}" for i in range(150)], []
    for _ in range(1500):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            copy[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(copy))
    docs, counts, write = pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), {}, Scratch.write

    def counted(self, df, name, *by, **options):
        out = write(self, df, name, *by, **options)
        if name in ("first", "rest", "pairs"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    got = near_dedup.near_components(spark.createDataFrame(docs)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked(docs)
    assert counts["first"] <= 1500 and counts["rest"] <= 3000 and counts["pairs"] <= 15_000


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = near_dedup.registers(x[:600]), near_dedup.registers(x[300:])
    assert np.array_equal(near_dedup.merged(a, b), near_dedup.registers(x))
    j = near_dedup.likely_jaccard(a[None], b[None], np.array([600.0]), np.array([600.0]))[0]
    assert abs(j - 1 / 3) < 0.2
    assert near_dedup.likely_jaccard(a[None], a[None], np.array([600.0]), np.array([600.0]))[0] > 0.99


# ------------------------------------------------------------------ packing
def test_pieces_are_the_tokenizers(spark, sf_dir):
    from tokenizers import Tokenizer

    got = packing.query(spark, sf_dir).toPandas()
    tokenizer, docs = Tokenizer.from_file(packing.vocabulary()), pd.read_parquet(f"{sf_dir}/documents.parquet")
    by_doc = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = by_doc[doc_id]
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in own.start]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1


def test_words_are_parted_as_the_tokenizer_does():
    encoder = packing.WordEncoder(packing.vocabulary(), most=50)
    assert encoder.parts
    texts = ["don't it's I'LL 'S x's", "İstanbul, ΑΣ. á, q́, e̸<", "<|endoftext|> a<|endoftext|>b", "a\x1cb \x85 x y 中文,字", "ABC!! DEF&&& gh%%% É$$$ 12a3 ½ ² ß ẞ ﬁ", "x" * 500]
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in [*range(1, 128), *range(0xA0, 0x250), *range(0x300, 0x345), *range(0x391, 0x3CF)]]
    texts += ["".join(rng.choice(letters, 12)) for _ in range(1500)]
    for text in texts:
        assert encoder.encode(text.encode()) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_every_capacity_holds():
    tokens = np.random.default_rng(8).integers(1, 700, 400)
    for rule in ("norm", "dot"):
        bins, offsets = packing.vector_best_fit(tokens, 1000, 3, 600_000, (1.0, 0.5, 0.5), rule)
        for b in np.unique(bins):
            own = tokens[bins == b]
            assert own.sum() <= 1000 and len(own) <= 3 and (own**2).sum() <= 600_000
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([11]), 10, 5, 1000, (1.0, 0.0, 0.0), "norm")


# ------------------------------------------------------------------ personal data and quality
def plain_spans(text: str) -> list:
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns(sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    rng = np.random.default_rng(9)
    texts += ["".join(rng.choice(list("ab1.@-+ (0)_%é\n"), 40)) for _ in range(3000)] + ["a@b@c.d", "a@b.c@d.e", "@a.b", "1.2.3.4.5.6.7.8", "a" * 50_000, "1" * 20_000 + ".1.1", "+1" + "(" * 20_000, "1.2.3.999 4111 1111 1111 1111"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text[:80]


def test_personal_data_query_is_the_patterns(spark, sf_dir):
    """Counts, digest and order of the whole query, by plain regular expressions."""
    got, docs = pii.query(spark, sf_dir).toPandas(), pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for i, text in zip(docs.doc_id, docs.text):
        spans = plain_spans(text)
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        want[i] = (*[sum(k == kind for _, k, _ in spans) for kind in range(4)], hashlib.sha256(",".join(listed).encode()).hexdigest())
        own = got[got.doc_id == i].spans.iloc[0].split(",")
        assert set(listed) <= set(own) and own == sorted(own, key=lambda x: (int(x.split(":")[1]) if x else 0, pii.KINDS.index(x.split(":")[0]) if x else 0))
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.itertuples()} == want


def spans_of(tags) -> set:
    out = set()
    for i, tag in enumerate(tags):
        if tag % 2:
            j = i + 1
            while j < len(tags) and tags[j] == tag + 1:
                j += 1
            out.add((i, j, int(tag)))
    return out


def test_field_on_held_out_lines():
    """Precision and recall of spans on lines made by another seed."""
    field, right, found, wanted = pii.train(), 0, 0, 0
    for text, tags in pii.made_lines(600, seed=99):
        _, _, code, maybe = pii.shapes(np.frombuffer(text.encode() + b" ", np.uint8))
        got, want = spans_of(pii.decode(field, code, maybe, np.zeros(1, np.int64))), spans_of(tags)
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    assert right / found > 0.95 and right / wanted > 0.95


def test_field_on_lines_of_its_own(spark):
    texts = ["Please phone 646.555.0143 or mail", "invoice 2024-1234 5678 again", "we sold 415 555 123 units", "tel. (312) 555-0182 im Haus"]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bool(r["spans"]) for r in got] == [True, False, False, True]


def test_long_tokens_keep_their_shape():
    """Tokens that differ beyond any prefix have shapes of their own."""
    tokens = [b"a1" * 200, b"a1" * 199 + b"-1", b"7" * 200, b"7" * 201, b"7" * 200 + b"x"]
    _, _, code, maybe = pii.shapes(np.frombuffer(b" ".join(tokens) + b" ", np.uint8))
    assert len(set(code.tolist())) == len(tokens) and maybe.all()


def test_field_learns_its_table_and_leaves_decoys():
    field = pii.train()
    for text, tags in pii.labelled_lines():
        _, _, code, maybe = pii.shapes(np.frombuffer(text.encode() + b" ", np.uint8))
        assert pii.decode(field, code, maybe, np.zeros(1, np.int64)).tolist() == tags.tolist()
    best = pii.viterbi(np.array([[[0.0, 1, -9, -9, -9, -9, -9, -9, -9]]]), np.array([1]), field.pair * 0)
    assert best.tolist() == [[1]]


def test_personal_data_of_whole_texts(spark):
    text = "é" * 10 + " write to ab.30@mail1.example.com or call (437) 555-0689 now; card 2353820953013749 "
    got = pii.personal_data(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["n_email"] == 1 and "email:20:43" in got[0]["spans"] and "phone" in got[0]["spans"] and "card" not in got[0]["spans"]
    assert got[1]["base_sha256"] == got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_quality_on_held_out_rows(spark):
    got = quality.query(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").merge(got, on="doc_id")
    own = labels[labels.held_out]
    assert (own.predicted == own.quality).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
