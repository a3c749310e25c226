"""Per-text operators against plain patterns, libraries and held-out rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import bpe, decontaminate, html_text, langid, pii, secrets, sharding, spans
from sigloom.llm.common import shingles, words

SF = "/root/testdata/sf0.001"


# Words ----------------------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text("aB \t\n\x0b é.", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles(texts):
    h, row, start, end = words(pa.array(texts, pa.string()))
    flat = [(r, w) for r, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert row.tolist() == [r for r, _ in flat]
    seen = {}
    for x, (_, w) in zip(h.tolist(), flat):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, rows = shingles(h, row)
    want = [tuple(w[k : k + 5]) for t in texts for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4)) if w]
    assert len(s) == len(want) and len(set(s.tolist())) == len(set(want))


# Byte-level BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Coder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab ", max_size=60), st.text("theinaon ,.'\n", max_size=60)), max_size=10))
@settings(max_examples=80, deadline=None)
def test_bpe_as_the_library(coders, texts):
    own, library = coders
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_bpe_remembers_a_bounded_number_of_words(coders, monkeypatch):
    """Whatever is forgotten, the result is the same."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    own, library = bpe.Coder(coders[0].ranks, bpe.public_vocabulary()[1]), coders[1]
    rng = np.random.default_rng(4)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice(list("etaoinshr"), 7)) for _ in range(6)) for _ in range(2)]
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(own.known) <= 40


def test_bpe_query(spark, coders):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 3000 + " " * 500, "x"), (1, "Hello world", "x")]
    path, pattern = bpe.public_vocabulary()
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), path, pattern).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == sorted((k, len(library_ids := coders[1].encode_ordinary(t or "")), np.array(library_ids, "<u4").tobytes(), (t or "").encode()) for k, t, _ in rows)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), path, pattern).collect() == []


# Personal data and secrets --------------------------------------------------------------------------


def plain_pii(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.one_of(st.text("a.@-+ 1(2)é", max_size=60), st.text("@.ab%", max_size=30), st.text("0123456789 -.+", max_size=60)))
@settings(max_examples=300, deadline=None)
def test_base_personal_data(t):
    assert [s[:3] for s in pii.finder()(t) if s[3]] == plain_pii(t)


def test_added_personal_data():
    found = pii.finder()("pay IBAN GB82 WEST 1234 5698 7654 32 or account number 12345678, see https://joe:pw@host/x and http://plain.org")
    assert [s[0] for s in found if not s[3]] == ["account", "account", "url"]


@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "+49 (30) 1234567", "+1", "+", "a@b.c", "@", ".", "-", " ", "12", "5", "٣", "é", "x", "://"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_personal_data_of_parts(t):
    assert [s[:3] for s in pii.finder()(t) if s[3]] == plain_pii(t)


@pytest.mark.parametrize("unit", ["account 12345678 ", "4111 1111 1111 1111, ", "1.2.3.4 ", "1.", "+1 234 567 890 x", "a@b.cd ", "a@", "1 ", "+1", "https://a@b/c ", "x"])
def test_personal_data_in_linear_time(unit):
    import time

    find, took = pii.finder(), []
    for n in (5000, 40_000):
        began = time.perf_counter()
        found = find(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5
    assert [s[:3] for s in found if s[3]] == plain_pii(unit * 40_000) or unit == "1."


@pytest.mark.parametrize("unit", ['token = "abcdefgh12" ', 'x.auth_key: "q9X!rT27_zz" ', "a = b ", "=", "a:", "password=", "'", '="', "deadbeef"])
def test_secrets_in_linear_time(unit):
    import time

    took = []
    for n in (5000, 40_000):
        began = time.perf_counter()
        found = secrets.find(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5
    assert [s[:3] for s in found if s[3]] == plain_secrets(unit * 40_000)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_taken_places(base, more):
    taken = spans.Taken([("k", a, a + n, True) for a, n in base])
    held = [(a, a + n) for a, n in base]
    for a, n in more:
        free = not any(a < y and x < a + n for x, y in held)
        assert taken.add(a, a + n) == free
        held += [(a, a + n)] * free


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH", "0123abcd", "deadbeef" * 3, "\n", "ſecret", "x"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_secrets(t):
    assert [s[:3] for s in secrets.find(t) if s[3]] == plain_secrets(t)


def test_constants_are_propagated():
    text = 'k = "q9X!rT27_zzP"\nname = "plain words here"\ndb_password = k\nclient_secret := "s3cr" + "et-Zx81"\nport: 8080\nauth_token = "${TOKEN}"\n'
    found = [text[a:b] for kind, a, b, base in secrets.find(text) if kind == "literal"]
    assert "q9X!rT27_zzP" in found and not any("plain" in f or "TOKEN" in f for f in found)


def test_redaction(spark):
    rows = [(1, 'x token = "abcdefgh12" y'), (2, None), (3, "clean"), (4, "")]
    got = dict(map(tuple, secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got[1].startswith("x [SECRET]") and "abcdefgh12" not in got[1] and got[2] is None and got[3] == "clean" and got[4] == ""


@pytest.mark.parametrize("module, columns", [(pii, ["n_email", "n_ip", "n_card", "n_phone"]), (secrets, ["n_assign", "n_access", "n_hex"])])
def test_span_queries(spark, module, columns):
    (query,) = module.QUERIES.values()
    plain = plain_pii if module is pii else plain_secrets
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert [r[c] for c in columns] == [sum(s[0] == c[2:] for s in want) for c in columns]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


# Language ID ----------------------------------------------------------------------------------------


def plain_phrases(text, sample):
    """Greedy parse into the longest pieces that occur in the sample; a letter that does not is a piece of its own."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


@given(st.text("abc", min_size=1, max_size=40), st.text("abcd", min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_phrases_are_the_longest_matches(sample, text):
    table = langid.Automata([langid.suffix_automaton([ord(c) - 97 for c in s]) for s in (sample, sample[::-1])], 4)
    letters, whole = np.array([ord(c) - 97 for c in text]), np.full(2, len(text))
    n, _ = table.parse(letters, np.arange(2), np.zeros(2, np.int64), whole, whole)
    assert n.tolist() == [plain_phrases(text, sample), plain_phrases(text, sample[::-1])]


@given(st.lists(st.text("abcd é1中𐐨", max_size=60), min_size=1, max_size=5), st.text("abcé 中𐐨", min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_texts_are_parsed_whole(texts, sample, piece):
    model = langid.Model({"x": [sample], "y": [sample[::-1]]})
    size, langid.PIECE = langid.PIECE, piece
    try:
        got = model.phrases(pa.array(texts))[0]
    finally:
        langid.PIECE = size
    clean = lambda t: re.sub(r"(?<=.)[ 1]+", " ", re.sub("^[ 1]+", " ", t.lower()))  # noqa: E731  runs of no letters are one
    own = {"x": clean(sample), "y": clean(sample[::-1])}
    for k, name in enumerate(model.names):
        assert got[:, k].tolist() == [plain_phrases(clean(t), own[name]) for t in texts]


def test_long_texts_and_many_letters():
    rng = np.random.default_rng(2)
    signs = [chr(0x4E00 + k) for k in range(2000)]
    two = {"p": "".join(signs[k] for k in rng.integers(0, 2000, 9000)), "q": "".join(signs[k] for k in rng.permutation(np.repeat(np.arange(2000), 4)))}
    model = langid.Model({k: [v] for k, v in two.items()})
    assert model.alphabet.size == 2002
    texts = [two["p"][3000:3200], two["q"][5000:5300], two["q"][100:200]]
    assert model.predict(pa.array(texts))[0] == ["p", "q", "q"]
    latin = langid.Model({"en": ["the cat and the dog and the bird " * 3], "aa": ["ab" * 50]})
    long = "the cat and the dog " * 5000 + "ab" * 10_000  # pieces of one period never meet by themselves
    got = latin.phrases(pa.array([long, None, "", long[:1000]]))
    letters = re.sub(" $", " ", long)
    for k, name in enumerate(latin.names):
        sample = ("ab" * 50) if name == "aa" else "the cat and the dog and the bird " * 3
        assert got[0][0, k] == plain_phrases(letters, sample) and got[0][1:3, k].tolist() == [0, 0]


def test_ties_go_to_the_name_that_sorts_first():
    model = langid.Model({"b": ["one text"], "a": ["one text"], "c": ["other"]})
    assert model.predict(pa.array(["one text"]))[0] == ["a"] and model.predict(pa.array(["one text"]))[1][0] == 0


def test_language_of_held_out_rows(spark):
    got = langid.op2_langid(spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(lang, on="doc_id")
    assert len(got) == len(lang) and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat and the dog and the bird", "en"), (2, "le chat et le chien et un oiseau", "fr"), (3, None, "en"), (4, "12 !!", None), (5, "", "fr"), (6, "the the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[6].lang_pred == "en" and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.where("false"))).collect()} == {"und"}


# Decontamination ------------------------------------------------------------------------------------


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    near = item.replace("twelve", "TWELFTH")
    far = " ".join(w if k % 3 else "zz" for k, w in enumerate(item.split()))
    docs = [(1, f"before {item.upper()} after"), (2, near), (3, far), (4, None), (5, ""), (6, "tiny thing"), (7, "a tiny thing here"), (1, item), (8, "x " * 30000 + item)]
    items = spark.createDataFrame([(10, item), (11, "tiny thing"), (12, None), (13, ""), (10, item)], "item_id long, text string")
    table = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, similarity int")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 3)) for r in decontaminate.find_leaks(table, items).collect())
    assert got == [(1, 10, 1.0), (1, 10, 1.0), (2, 10, 0.778), (6, 11, 1.0), (7, 11, 1.0), (8, 10, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table, items).collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(table, items.where("false")).collect() == []


def test_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    items = decontaminate.Items(list(range(50)), [" ".join(f"w{rng.integers(500)}" for _ in range(30)) for _ in range(50)])
    for k in range(50):
        bits = np.unpackbits(items.prints[k].astype(">u2").view(np.uint8))
        bits[rng.choice(128, decontaminate.RADIUS, replace=False)] ^= 1
        assert k in items.within(np.packbits(bits).view(">u2").astype(np.uint16))


def plain_leaks(docs, items):
    """(row, item) -> similarity of the most similar window: all windows of all items' sizes, one by one."""
    cut = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    sizes = {len(i.split()) for i in items}
    out = {}
    for r, d in enumerate(docs):
        w = d.split()
        bags = [cut(w[a : a + size]) for size in sizes for a in range(max(1, len(w) - size + 1))]
        for k, i in enumerate(items):
            want = cut(i.split())
            best = max(sum((b & want).values()) / sum((b | want).values()) for b in bags)
            if best >= decontaminate.THRESHOLD:
                out[r, k] = best
    return out


def as_plain(docs, items):
    got = decontaminate.Items(list(range(len(items))), items).leaks(pa.array(docs))
    want = plain_leaks(docs, items)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    return got


def test_repeated_words_as_all_windows():
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    items, docs = [], []
    for size, run in ((500, 40), (200, 25), (100, 11), (60, 5)):
        item = some(size)
        items.append(" ".join(item))
        docs.append(" ".join(some(30) + item[:-run] + ["____"] * run + some(30)))
        docs.append(" ".join(item[run:]))  # shorter than the item
    items.append(" ".join(["x"] * 90 + some(12)))
    docs.append(" ".join(some(20) + ["x"] * 90 + some(32)))  # of distinct shingles hardly any are shared
    assert {(0, 0), (2, 1), (4, 2), (8, 4)} <= set(as_plain(docs, items))


def test_reordered_parts_as_all_windows(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    halves, options = some(40), [some(13) for _ in range(4)]
    items = [" ".join(halves), " ".join(sum(options, []))]
    docs = [" ".join(some(50) + halves[20:] + halves[:20] + some(50)), " ".join(some(30) + sum(options[2:] + options[:2], []) + some(30)), " ".join(some(90))]
    got = as_plain(docs, items)
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0] == (0.8, 50, 40)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = decontaminate.without_leaks(table, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_rolled_fingerprints():
    rng = np.random.default_rng(6)
    for _ in range(30):
        s = rng.integers(0, rng.integers(1, 40), 60).astype(np.uint64)
        size = int(rng.integers(1, 30))
        low, high = sorted(rng.integers(0, 60 - size + 1, 2).tolist())
        want = np.array([decontaminate.fingerprint(s[a : a + size]) for a in range(low, high + 1)])
        assert (decontaminate.rolled(s, size, low, high) == want).all()


def test_index_of_many_items():
    """Probing by flips of a block and by the values there finds the same items."""
    rng = np.random.default_rng(7)
    items = decontaminate.Items(list(range(400)), [" ".join(f"w{k}" for k in rng.integers(0, 300, 12)) for _ in range(400)])
    asked = rng.integers(0, 1 << 16, (40, decontaminate.BLOCKS)).astype(np.uint16)
    asked[:20] = items.prints[:20] ^ (1 << rng.integers(0, 16, (20, decontaminate.BLOCKS))).astype(np.uint16)
    close = np.bitwise_count(asked[:, None, :] ^ items.prints[None]).sum(axis=2) <= decontaminate.RADIUS
    want = np.flatnonzero(close.any(axis=0)).tolist()
    assert items.within(asked).tolist() == want and set(range(20)) <= set(want)
    more = decontaminate.Items(list(range(9000)), [" ".join(f"w{k}" for k in rng.integers(0, 300, 12)) for _ in range(9000)])
    assert len(more.tables[0][0]) > len(decontaminate._MASKS)
    close = np.bitwise_count(more.prints[:5, None, :] ^ more.prints[None]).sum(axis=2) <= decontaminate.RADIUS
    assert more.within(more.prints[:5]).tolist() == np.flatnonzero(close.any(axis=0)).tolist()


def test_random_edits_as_all_windows():
    """Replaced, dropped, moved and repeated words, at similarities on both sides of the threshold."""
    rng = np.random.default_rng(8)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 9000, n)]
    items = [some(int(n)) for n in rng.integers(12, 90, 12)]
    docs = []
    for k in range(80):
        w = list(items[k % 12])
        for _ in range(int(rng.integers(0, 1 + len(w) // 25)) if k % 3 else 1):
            at, kind = int(rng.integers(len(w))), int(rng.integers(4))
            w = [*w[:at], *([some(1), [], [w[at]] * 3, ["____"] * 4][kind]), *w[at + 1 :]]
        docs.append(" ".join(some(int(rng.integers(0, 60))) + w + some(int(rng.integers(0, 60)))))
    got = as_plain(docs, [" ".join(i) for i in items])
    assert 20 < len(got) < 80


def test_long_runs_of_one_word_take_linear_time():
    import time

    took = []
    for n in (4000, 16_000):
        items = decontaminate.Items([0], [" ".join(["x"] * n)])
        began = time.perf_counter()
        assert items.leaks(pa.array([" ".join(["x"] * 2 * n)]))[0, 0][0] == 1.0
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_keys_of_other_types_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([("a", item, "clash"), (None, item, "x"), ("b", None, "x")], "doc_id string, text string, item_id string")
    items = spark.createDataFrame([(7, item), (7, item)], "item_id int, text string")
    got = decontaminate.find_leaks(docs, items)
    assert sorted((r.doc_id or "", r.item_id) for r in got.collect()) == [("", 7), ("a", 7)]
    assert dict(got.dtypes)["item_id"] == "int" and [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == ["b"]
    assert decontaminate.find_leaks(docs.where("false"), items).collect() == [] == decontaminate.without_leaks(docs.where("false"), items).collect()


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    texts = [" ".join(f"w{i}_{k}" for k in range(20)) for i in range(5)]
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(i, i) for i in range(5)]
    assert decontaminate.without_leaks(docs, items).collect() == []


@given(st.lists(st.text("ab", min_size=5, max_size=14), min_size=1, max_size=4), st.lists(st.text("abc", min_size=5, max_size=40), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_leaks_of_few_words_as_all_windows(items, docs):
    as_plain([" ".join(d) for d in docs], [" ".join(i) for i in items])


# Sharding -------------------------------------------------------------------------------------------


def test_shards(spark):
    got = sharding.op6_sharding(spark, "/root/testdata/sf0.01").toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == 1000 and counts.max() - counts.min() <= 1 and set(counts.index) == set(range(8))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    rows = spark.createDataFrame([(1, "é", 5), (1, "é", 5), (2, None, 5)], "doc_id long, text string, shard int")
    small = sharding.shuffle_to_shards(rows, 2).collect()
    assert sorted((r.shard, r.slot) for r in small) == [(0, 0), (0, 1), (1, 0)]
    assert sharding.shuffle_to_shards(rows.where("false"), 2).collect() == []


def test_hypergeometric_draws_follow_the_law():
    """Frequencies of small draws against the exact distribution, and large ones against its mean and spread."""
    from math import comb

    rng = np.random.default_rng(3)
    for good, bad, n in ((3, 4, 5), (40, 60, 30), (500, 300, 400), (1000, 7, 900)):
        drawn = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=good + 1)
        exact = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if 0 <= n - k <= bad else 0.0 for k in range(good + 1)])
        assert drawn[exact == 0].sum() == 0
        some = exact * 4000 > 8
        chi = ((drawn - exact * 4000)[some] ** 2 / (exact * 4000)[some]).sum()
        assert chi < some.sum() + 5 * (2 * some.sum()) ** 0.5
    good, bad, n = 10**12, 3 * 10**12, 10**11
    large = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2000)], float)
    mean, var = n * 0.25, n * 0.25 * 0.75 * (good + bad - n) / (good + bad - 1)
    assert abs(large.mean() - mean) < 5 * (var / 2000) ** 0.5 and 0.85 < large.var() / var < 1.15


def test_counts_of_partitions():
    counts = np.array([700, 0, 300, 25, 1])
    rows = [sharding.Matrix(counts, 8, 1).row(p) for p in range(5)]
    assert [r.sum() for r in rows] == counts.tolist()
    assert np.sum(rows, axis=0).tolist() == [129, 129] + [128] * 6
    many = sharding.Matrix(np.full(1_000_000, 30_000), 8, 1)  # a row of a matrix that is never whole in one place
    assert many.row(777_777).sum() == 30_000 and (np.abs(many.row(5) - 3750) < 500).all()


def test_every_row_may_go_anywhere(spark):
    """Shares of (shard, slot) over many seeds: no place is preferred by any row."""
    rows = spark.range(0, 12, 1, 3).withColumnRenamed("id", "_p")
    places = np.zeros((12, 12))
    for seed in range(60):
        for r in sharding.shuffle_to_shards(rows, 3, seed, 2).collect():
            places[r["_p"], r.shard * 4 + r.slot] += 1
    assert (places.sum(axis=0) == 60).all() and ((places - 5) ** 2 / 5).sum() < 121 + 5 * (2 * 121) ** 0.5


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, k, k, k, k, k) for k in range(50)], "_p long, _r long, _n long, _cell long, _first long, `odd name` long")
    got = sharding.shuffle_to_shards(rows, 4, cell_rows=3)
    assert got.columns == [*rows.columns, "shard", "slot"] and sorted(r["odd name"] for r in got.collect()) == list(range(50))
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, k) for s in range(4) for k in range(13 - (s > 1))]


# Pages ----------------------------------------------------------------------------------------------


def test_pages(spark):
    got = html_text.op9_html(spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    from html import unescape

    for html, text in zip(pages.sort_values("page_id").html, got.sort_values("page_id").text):
        inner = re.sub(r"</?b>", "", re.search("<article>(.*?)</article>", html, re.S)[1])
        assert text == " ".join(unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_page_edges(spark):
    weights = html_text.Weights(["<body><nav><a>x</a></nav><article><h1>T</h1><p>some words here</p></article><footer>f</footer></body>"])
    cases = {
        "": "",
        "plain text only": "plain text only",
        "<p>a&nbsp;&amp; b<br>c</p>\n<p> d<b>e</b></p>": "a & b c de",
        "<div class='cookie-notice'>We use cookies on this site</div><div><p>Body text of the page is here</p></div><section id='comments'><p>first comment</p></section>": "Body text of the page is here",
        "<article><p>Start of it</p><aside>see also</aside><form><input>Sign up</form><ul><li>one</li><li>two</li></ul></article><p>more from us and others here</p>": "Start of it one two",
        "<script>var a = '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes indeed</p>": "yes indeed",
        "<p>unclosed <b>tag < and more": "unclosed tag < and more",
    }
    for html, want in cases.items():
        assert html_text.main_text(html, weights) == want, html
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>x" + " y" * 100_000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(rows, weights).collect()}
    assert got[1] == got[2] == "" and len(got[3]) == 200_001


def test_left_out_parts_in_an_article_cost_nothing():
    page = "<head><style>p{}</style></head><body>" + "<script>x</script><svg></svg><iframe></iframe>" * 20 + "<article><h1>T</h1><p>some words here</p></article></body>"
    weights = html_text.Weights([page])
    cases = {
        "<article><h1>Two words</h1><script>var a</script><p>and some more text</p></article>": "Two words and some more text",
        "<article><p>and some more text</p><script>a</script><style>b</style><iframe></iframe><p>The end</p></article>": "and some more text The end",
        "<article><p>Start of it</p><svg viewBox='0 0 1 1'/><MATH/><p>the end part</p></article>": "Start of it the end part",
        "<article><p>Start <svg-icon name='x'></svg-icon>of text</p><title-bar>a bar</title-bar><p>the end</p></article>": "Start of text a bar the end",
        "<article><p>Start of it</p><svg a='/>'><path d='1'/><text>no</text></svg><p>the end part</p></article>": "Start of it the end part",
        "<!-- <article> --><p>beside it</p><main><p>real text is here</p></main>": "real text is here",
        "<script>'<article>'</script><article-list></article-list><p>plain text of a page</p>": "plain text of a page",
    }
    for html, want in cases.items():
        assert html_text.main_text(html, weights) == want, html


LABELLED = ["<body><nav><ul><li><a>one</a></li><li><a>two three</a></li></ul></nav><div class='promo-x'>buy it now</div><div class='teaser'>more to read in here</div><article><h1>T</h1><p>some words here " + "and more " * 40 + "</p></article><footer>f 2020</footer></body>"] * 3


def test_the_scan_decides_on_pages_without_an_article():
    weights = html_text.Weights(LABELLED)
    links = "".join(f"<div><a href='/{k}'>link number {k}</a></div>" for k in range(12))
    body = "<h2>A title</h2><p>The body of this page has a number of words.</p><div><p>It goes on in here.</p></div><table><tr><td>cells too</td></tr></table><p>And it ends.</p>"
    want = "A title The body of this page has a number of words. It goes on in here. cells too And it ends."
    cases = {f"<body>{links}<div id='x'>{body}</div>{links}</body>": want, f"<body>{links}{body}</body>": want, f"<html><body><center>{links}</center>{body}{links}": want}
    for html, text in cases.items():
        assert html_text.main_text(html, weights) == text, html
        row = html_text.tokens(html, weights)
        whole = " ".join(" ".join(t[1] for t in row if t[0] == "text").split())
        assert len(whole) > len(text)  # without the scan there would be more


def test_what_labelled_pages_teach():
    weights, none = html_text.Weights(LABELLED), html_text.Weights([])
    page = "<body><div class='teaser'>five more words to read</div><p>The body of this page has many words in it.</p></body>"
    assert html_text.main_text(page, weights) == "The body of this page has many words in it."
    assert html_text.main_text(page, none).startswith("five more words")
    assert weights.word(["nav"]) < 0 < weights.word(["p"]) and weights.word(["div", "a"]) < 0 < weights.word(["in", "p", "a"])
    assert weights.tag["nav"] < weights.tag["p"] < 0


def test_articles_lose_nothing():
    weights = html_text.Weights(LABELLED)
    cases = {
        "<article><p>Before it</p><div class='related-work'><p>Others did it too</p></div><p>after it</p></article>": "Before it Others did it too after it",
        "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>": "Let x=1 be",
        "<article><ul><li><a href='/'>All of it</a></li><li><a href='/'>in links</a></li></ul></article><p>beside it there is more text</p>": "All of it in links",
        "<article><p>One</p><div class='comment-list'><p>nice post, thank you so much for it</p></div><div class='ad'>buy buy buy buy</div><p>two</p></article>": "One two",
        "<article><header><h1>Head line</h1></header><p>text</p></article><header>site name here</header>": "Head line text",
    }
    for html, want in cases.items():
        assert html_text.main_text(html, weights) == want, html


def test_values_of_attributes_are_no_names():
    weights = html_text.Weights(LABELLED)
    rest = "<p>First words of the page stand here</p>"
    cases = {
        f"<article>{rest}<p>a <a href='/wiki/hidden-falls'>waterfall called Foo</a></p></article>": "First words of the page stand here a waterfall called Foo",
        f"<article><p title='Hidden gems'>Gems</p>{rest}</article>": "Gems First words of the page stand here",
        f"<article><p onclick='toggle(hidden)'>Gems</p>{rest}</article>": "Gems First words of the page stand here",
        f"<article data-title='The hidden path'>{rest}</article>": "First words of the page stand here",
        f"<div data-hidden='false'>{rest}</div>": "First words of the page stand here",
        f"<article>{rest}<a href='/t?id=comments'>and more</a></article>": "First words of the page stand here and more",
        f"<article>{rest}<a href=/t?class=ad>and more</a></article>": "First words of the page stand here and more",
        f"<form id='aspnetForm'><nav>a b</nav><article>{rest}</article><footer>c</footer></form>": "First words of the page stand here",
        f"<body><form id='f'><h1>Head</h1>{rest}</form></body>": "Head First words of the page stand here",
        f"<article>{rest}<span aria-hidden='true'>visible</span><p hidden>gone</p><p HIDDEN=''>gone</p></article><form><p>Your name</p></form>": "First words of the page stand here visible",
        f"<article>{rest}<form><p>Sign up</p></form><form><p>unclosed": "First words of the page stand here",
    }
    for html, want in cases.items():
        assert html_text.main_text(html, weights) == want, html
    assert html_text.attributes_of(" a=1 B='x hidden' hidden c = \"d='e'\" / f") == [("a", "1"), ("b", "x hidden"), ("hidden", ""), ("c", "d='e'"), ("f", "")]


VALUES = ["hidden", "/wiki/hidden-falls", "id=comments", "class='ad'", "display:none", "role=navigation", "the style hidden", "x"]
ELEMENTS = ["p", "div", "span", "a", "b", "li", "td", "h2", "section", "blockquote"]
LEFT = ["<script>no</script>", "<nav><p>no</p></nav>", "<aside>no</aside>", "<div class='ad'>no</div>", "<!-- no -->", "<p hidden>no</p>", "<form><p>no</p></form>"]


@given(st.lists(st.tuples(st.sampled_from(ELEMENTS), st.lists(st.tuples(st.sampled_from(["title", "href", "data-id", "data-hidden", "onclick", "alt"]), st.sampled_from(VALUES)), max_size=2), st.sampled_from([*LEFT, ""])), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_every_word_of_an_article_is_kept(row):
    """All words but those in left-out elements, whatever other attributes are set to."""
    html, want = "", []
    for k, (tag, attributes, left) in enumerate(row):
        said = "".join(f' {a}="{v}"' for a, v in attributes)
        html += f"<{tag}{said}> w{k}</{tag}>{left}"
        want.append(f"w{k}")
    assert html_text.main_text(f"<nav><a>x</a></nav><article>{html}</article><footer>y</footer>", html_text.Weights(LABELLED)).split() == want


@given(st.lists(st.sampled_from([-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 3.0]), max_size=14))
@settings(max_examples=200, deadline=None)
def test_region_against_all_intervals(scores):
    start, end = html_text.region(scores)
    best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])
    assert sum(scores[start:end]) == best and (best > 0 or start == end)


def test_clashing_columns_and_empty_tables(spark):
    mail = spark.createDataFrame([(1, "a@b.cd", "old", 7), (2, None, "old", 7), (1, "a@b.cd", "old", 7)], "doc_id long, text string, spans string, score int")
    got = pii.personal_data(mail).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.spans] for r in got] == [[("email", 0, 6, True)]] * 2 + [[]] and got[0].score == 7
    assert secrets.secrets(mail.where("false")).collect() == [] and pii.personal_data(mail.where("false")).collect() == []
    model = langid.Model({"en": ["the cat and the dog"], "fr": ["le chat et le chien"]})
    named = langid.identify(mail.withColumn("lang_pred", mail.spans), model).collect()
    assert {r.lang_pred for r in named} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in named)
    assert langid.identify(mail.where("false"), model).collect() == []
    pages = spark.createDataFrame([(1, "u", "<p>x y</p>", "old")], "page_id long, url string, html string, text string")
    weights = html_text.Weights([])
    assert [r.text for r in html_text.extract(pages, weights).collect()] == ["x y"]
    assert html_text.extract(pages.where("false"), weights).collect() == []
