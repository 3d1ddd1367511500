"""Each operator against a plain version of itself, on small tables and odd texts."""

import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelark.llm import _points, ann, fingerprint, langid, mixing, quality, secret_scan, simhash, toxicity
from tidelark.llm.near_copies import drop_near_copies

ODD = ["", " ", "one", "Straße STRASSE  straße", " x y", "a\tb\x0bc\rd", "ÀÉ 𐌰𐌱𐌲 𐌰𐌱", "ﬁne ﬀ Ⅷ", "x" * 700, "word " * 900, "1 2 3 ### !!", "Ünï cödé İstanbul ΟΔΟΣ ΟΔΟΣ", "eq eq eq eq", "pass word\npassword: abcdef12 token=zz9999"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(ODD)] + [(100, None, None, None, None), (3, ODD[3], "en", "s", 1), (None, "no id", "en", "s", 5)]
    return spark.createDataFrame(rows, DOCS)


# op1


@pytest.mark.parametrize("n", [1, 6, 257, 1300])
def test_neighbours_with_defaults(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 24))
    table = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string")
    step = 1 if n < 10 else 50
    got = {}
    for r in ann.search(table, F.col("vec_id") % step == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    s = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    np.fill_diagonal(s, -9)
    want = {q: np.argsort(-s[q], kind="stable")[: min(5, n - 1)].tolist() for q in range(0, n, step)}
    assert sorted(got) == (sorted(want) if n > 1 else [])
    assert all(len(got[q]) == len(want[q]) for q in got)
    hits = sum(len(set(got[q].values()) & set(want[q])) for q in got)
    assert hits >= 0.95 * sum(map(len, want.values())) * (n > 1)


def test_beam_grows_until_recall_is_reached(spark):
    x = np.random.default_rng(1).normal(size=(4000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 50 == 0, neighbours=10, beam=40).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    sims = u[::50] @ u.T
    sims[np.arange(80), np.arange(0, 4000, 50)] = -9
    true = np.argsort(-sims, axis=1)[:, :5]
    assert sum(len(near[50 * i] & set(t.tolist())) for i, t in enumerate(true)) / 400 > 0.93  # 0.9 with the first beam


def test_neighbours_of_equal_short_and_long_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0]), (6, [2.0]), (7, [1.0] * 5000), (None, [1.0, 0.0])]
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()}
    assert out[1, 1] == (2, 1.0) and out[1, 2][0] == 4 and out[1, 3] == (3, 0.0)
    assert out[5, 1] == (6, 1.0) and (7, 1) not in out and (5, 2) not in out


# op2


def test_mixture_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 40))), None, [None, "b", "a", "ü"][int(rng.integers(4))], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(len(r[1].split()) for r in rows if r[3] == n) for n in names}
    left, budget, target = list(names), 1.5 * sum(size.values()), {}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    while left:
        level = budget / sum(weight[n] for n in left)
        full = [n for n in left if level * weight[n] > 2 * size[n]]
        target |= {n: 2.0 * size[n] for n in full} if full else {n: level * weight[n] for n in left}
        budget -= sum(2 * size[n] for n in full)
        left = [n for n in left if n in full and False or n not in target]
    got = mixing.plan_mixture(docs).collect()
    for r, (_, text, _, source, _) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert r.size == len(text.split()) and r.source_size == size[source] and math.isclose(r.target, target[source]) and r.taken <= 2 * r.size
    for n in names:
        taken = sum(r.taken for r in got if rows[r.doc_id][3] == n)
        assert abs(taken - target[n]) <= 2 * 40
    assert sorted(got) == sorted(mixing.plan_mixture(docs).collect())
    starts = spark.range(1).select(*[mixing.offset(F.lit(n).cast("string"), 42).alias(str(n)) for n in names]).first()
    assert len(set(starts)) == len(names) and all(0 <= x < 1 for x in starts)


def test_mix_and_copies_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1, 2, 3, 4), (2, "a b c", "x", 1, 2, 3, 4), (3, "zz", "y", 1, 2, 3, 4)], "doc_id long, text string, source string, __copies int, __from int, __id int, row int")
    assert mixing.mix(docs).columns == docs.columns
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 3]


# op3


def test_fingerprints_bit_by_bit(odd):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for r in simhash.near_duplicate_groups(odd).collect():
        assert r.fp % (1 << 64) == plain(None if r.doc_id == 100 else "no id" if r.doc_id is None else ODD[r.doc_id])


# op4


def test_quality_statistics():
    _, _, value, got = quality.features(ODD)
    assert value.max() <= 1 + 1e-9
    for text, row in zip(ODD, got, strict=True):
        words = text.split()
        low = text.lower()
        assert math.isclose(row[0], math.log1p(len(words)))
        assert math.isclose(row[1], sum(c.isalpha() for c in low) / max(1, sum(map(len, low.split()))))
        assert math.isclose(row[6], low.count("\n") / max(1, len(words)))


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    good, bad = (["w%d" % i for i in r] for r in (range(200), range(150, 350)))
    texts = [" ".join(rng.choice(good if i % 2 else bad, 50)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    out = [r for r in quality.score_quality(docs, labels).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == r.doc_id % 2 for r in out]) > 0.9


# op6


def test_base_spans_by_brute_force(odd):
    rng = np.random.default_rng(6)
    parts = ["password", "API_KEY", "apikey", "token", '"', "'", " ", ":", "=", "abcdef", "x/y+z", "AKIA", "ABCDEFGHIJKLMNOP", "Q1", "0123456789ab", "cdef01234567", "\n", "é"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 30)))) for _ in range(300)]

    def plain(t):
        out = []
        for kind, order, pattern, ok in (
            ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
            ("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", 2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        ):
            out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, t) if ok(m)]
        return [(k, s, e) for s, _, e, k in sorted(out)]

    docs = odd.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = secret_scan.scan_secrets(docs)
    rows = scanned.select("doc_id", *[c.alias(n) for n, c in secret_scan.digest(F.col("secrets")).items()]).collect()
    for r in rows:
        want = plain(texts[r.doc_id])
        count = lambda k: sum(x == k for x, *_ in want)  # noqa: E731, B023
        assert (r.n_assign, r.n_access, r.n_hex) == (count("assign"), count("access"), count("hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    assert secret_scan.scan_secrets(odd).count() == odd.count() and secret_scan.scan_secrets(odd.where("false")).count() == 0


def test_confirmation():
    import base64

    def value(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body

    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    wrapped = lambda s, end: end.join(s[i : i + 64] for i in range(0, len(s), 64))
    armour = lambda label, body, end="\n": f"-----BEGIN {label}-----{end}{body}{end}-----END {label}-----"
    kinds = lambda t: [k for k, *_ in secret_scan.confirmed_spans(t)]
    rsa = value(0x30, value(2, b"\0") + b"".join(value(2, bytes([7]) * n) for n in (257, 3, 256, 129, 129, 129, 129, 129)))
    pkcs8 = value(0x30, value(2, b"\0") + value(0x30, value(6, bytes.fromhex("2a864886f70d010101")) + b"\x05\0") + value(4, rsa))
    wrong = value(0x30, value(2, b"\0") + value(0x30, value(6, bytes.fromhex("2a864886f70d010199")) + b"\x05\0") + value(4, rsa))
    assert kinds("x " + armour("RSA PRIVATE KEY", wrapped(b64(rsa), "\n"))) == ["pem"]
    assert kinds('{"k": "' + armour("PRIVATE KEY", wrapped(b64(pkcs8), "\\n"), "\\n") + '"}') == ["pem"]
    assert kinds("key:\n" + wrapped(b64(pkcs8), "\r\n") + "\nnext line") == ["der"] and kinds(b64(wrong)) == []
    assert kinds(armour("ENCRYPTED PRIVATE KEY", "AAAAAAAA")) == [] and kinds(armour("RSA PRIVATE KEY", "prose")) == []
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    assert kinds(armour("RSA PRIVATE KEY", head + b64(bytes(64)))) == ["pem"] and kinds(armour("RSA PRIVATE KEY", head + b64(bytes(63)))) == []
    assert kinds(f'see x.{url(b"""{ "alg": "HS256"}""")}.{url(b"{}")}.sig') == ["jwt"] and kinds(f"{url(b'''{'a':1}''')}.{url(b'{}')}.s") == []
    many = "-----BEGIN RSA PRIVATE KEY-----\n" * 30_000
    assert kinds(many) == []


# op7 and op9: long texts are one text


def test_pieces_share_words():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefg𐌰é"), int(rng.integers(1, 7)))) for _ in range(50)]
    text = " ".join(rng.choice(words, 800))
    margin = rng.normal(size=1 << toxicity.BITS)
    m = langid.train([text[:500], text[700:1200]], ["a", "b"])
    whole = toxicity.window_margins([text], margin, 3), langid.log_likelihood([text], m), langid.gram_counts([text])
    big = _points.pieces.__defaults__
    try:
        _points.pieces.__defaults__ = (97, *big[1:])
        cut = toxicity.window_margins([text], margin, 3), langid.log_likelihood([text], m), langid.gram_counts([text])
    finally:
        _points.pieces.__defaults__ = big
    assert np.allclose(whole[0], cut[0]) and np.allclose(whole[1][0], cut[1][0]) and (whole[1][1] == cut[1][1]).all() and np.allclose(whole[2], cut[2])


def test_windows_by_brute_force():
    margin = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    for text in ODD:
        words = re.findall(r"[^\W\d_]+", text.lower())
        each = [toxicity.window_margins([w], margin, 3)[0] for w in words]
        want = max((np.mean(each[i : i + 3]) for i in range(max(1, len(each) - 2)) if each), default=-np.inf)
        got = toxicity.window_margins([text], margin, 3)[0]
        if "Ⅷ" not in text:  # no letter, though a word character
            assert got == want or np.isclose(got, want)


def test_toxicity_is_learned(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    texts = [t if i % 3 else t.replace(" ", " zzworst ", 1) for i, t in enumerate(texts)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.9
    assert all(r.score < 0.01 and r.predicted == 0 for r in out if r.doc_id >= 300)


def test_language_is_the_largest_posterior(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cd", "ef"] if i % 4 else ["gh", "cd", "𐌰𐌱"], 12)) for i in range(160)] + ["𐌰𐌱", "", None, "12 ##"]
    docs = spark.createDataFrame([(i, t, None if i >= 160 else "x" if i % 4 else "y", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "y", "s", 0)] * 3, DOCS)
    model = langid.fit(docs)
    assert model.languages == ["x", "y"]
    learned = [(i, i % 4 == 0) for i in [*range(160), 0, 0, 0] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert np.allclose(np.exp(model.prior), [np.mean([not y for _, y in learned]), np.mean([y for _, y in learned])])
    out = {r.doc_id: r for r in langid.predict_language(docs).collect()}
    assert all(out[i].lang_pred == ("x" if i % 4 else "y") for i in range(160))
    assert out[160].lang_pred == "y" and [out[i].lang_pred for i in (161, 162, 163)] == ["und"] * 3
    z, _ = langid.log_likelihood(texts[:160], model)
    assert [model.languages[k] for k in (z + model.prior).argmax(1)] == [out[i].lang_pred for i in range(160)]


# op10


def test_fingerprints_of_documents(odd):
    def form(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    texts = {**dict(enumerate(ODD)), 100: ""}
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    for i, r in rows.items():
        text, following = texts[i], texts[after[i]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(form(text) == form(edited)) and r.near_next == float(form(text) == form(following))
        for j, other in rows.items():
            assert (r.fingerprint == other.fingerprint) == (form(text) == form(texts[j]))
