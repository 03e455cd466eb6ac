"""Personal data, language identification, benchmark decontamination, the salvage reader."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from cohortloom.llm import op04_pii as pii
from cohortloom.llm import op05_langid as lid
from cohortloom.llm import op07_warc as warc
from cohortloom.llm import op10_decontaminate as dec

from .fixtures import LONG, ODD, docs_of, held_items

rng = random.Random(8)


# personal data


def test_entities_of_held_out_texts():
    model, r = pii.train(), random.Random(99)
    right = found = gold = 0
    for _ in range(400):
        text, spans = pii.example(r)
        want, got = {(k, s, e) for s, e, k in spans}, set(pii.entities(text, model))
        right, found, gold = right + len(want & got), found + len(got), gold + len(want)
    assert right / found > 0.93 and right / gold > 0.93


def all_segmentations(n, segs):
    """Every way to cover a run by outside tokens and typed segments."""
    if n == 0:
        yield []
        return

    def go(at):
        if at == n:
            yield []
            return
        for rest in go(at + 1):
            yield [(None, None), *rest]
        for x, (i, j, *_r) in enumerate(segs):
            if i == at:
                for rest in go(j):
                    for y in range(len(pii.KINDS)):
                        yield [(x, y), *rest]

    yield from go(0)


def worth(model, segs, way):
    s, total, prev = model.scores(segs), 0.0, 0
    for x, y in way:
        now = 0 if x is None else y + 1
        total += model.a[prev, now] + (0 if x is None else s[x, y])
        prev = now
    return total


def test_decoding_and_normalisation_are_those_of_all_segmentations():
    r = np.random.default_rng(3)
    model = pii.train()
    for text in ("1 2 3", "a=1 b2", "+1 (555) 123-4567", "1 22 333 4444 55555", "x1 (2) 3@4.de"):
        toks, before = next(iter(pii.runs(text)))
        toks = toks[: 5 if text[0] in "1x" else 3]
        segs = pii.segments(text, toks, before)
        noisy = pii.Model(model.names, model.w + r.normal(0, 1, model.w.shape), model.a + r.normal(0, 1, model.a.shape))
        ways = [(worth(noisy, segs, w), w) for w in all_segmentations(len(toks), segs)]
        best = max(ways, key=lambda x: x[0])
        got = noisy.decode(len(toks), segs)
        assert got == [(x, y) for x, y in best[1] if x is not None]
        z = pii.marginals(noisy, len(toks), segs)[2]
        assert z == pytest.approx(math.log(sum(math.exp(w - best[0]) for w, _ in ways)) + best[0])


def test_entities_have_their_places(spark):
    rows = [(1, "write to jane.doe@mail.com or call +1 (212) 555-0147 now"), (2, 'token="a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6" in the 2019 file'), (3, "plain words only"), (4, None), (5, "😀 at 10.20.30.40 ok"), (5, "😀 at 10.20.30.40 ok")]
    text = dict(rows)
    got = [(r.doc_id, r.kind, text[r.doc_id][r.start : r.end]) for r in pii.find_pii(docs_of(spark, rows)).collect()]
    assert {(1, "email", "jane.doe@mail.com"), (1, "phone", "+1 (212) 555-0147"), (5, "ip", "10.20.30.40")} <= set(got)
    assert got.count((5, "ip", "10.20.30.40")) == 2 and any(d == 2 and k == "secret" for d, k, _ in got) and not {3, 4} & {g[0] for g in got}


def test_entities_of_awkward_rows(spark):
    rows = [*ODD, (60, "1 " * 20_000), (61, "=" * 500), (62, "@ @ = = 5"), (63, "x" * 3000 + "1")]
    rows += [(64, "my server 1.2.3.\u00b2 here, \u0661\u0662.\u0663.\u0664.\u0665 and \u0664" + "\u0665" * 15), (65, "\x00 a@b.org"), (66, LONG + " jane@x.org"), (67, "pay 10.20.30.40"), (67, "pay 10.20.30.40")]
    got = sorted(((r.doc_id, r.kind, r.start, r.end) for r in pii.find_pii(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, *e) for i, t in rows if t for e in pii.entities(t, pii.train())), key=repr)
    assert (66, "email", len(LONG) + 1, len(LONG) + 11) in got and got.count((67, "ip", 4, 15)) == 2 and (65, "email", 2, 9) in got
    assert not {g[0] for g in got} & {1, 2, 3, 4, 5, 6, 7, 10, 61}
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def test_signs_take_linear_time():
    model = pii.train()
    for sign in "=-(":
        took = []
        for n in (50_000, 200_000):
            began = time.process_time()
            assert pii.entities(sign * n + "a", model) == []
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5


def test_entities_of_the_forms_people_write():
    for text, want in (("call 020 7946 0958 now", ("phone", "020 7946 0958")), ("call 0171 234 5678 now", ("phone", "0171 234 5678")), ("or 01 23 45 67 89 then", ("phone", "01 23 45 67 89")),
                       ("password: hunterxyz", ("secret", "hunterxyz")), ("token = " + "aB3" * 150, ("secret", "token = " + "aB3" * 150))):
        assert entity_texts(text) == [want], text
    for text in ("password: required", "password: optional", "in 12 345 678 cases of 2019 2020", "the 01 02 03 of it"):
        assert entity_texts(text) == [], text


def entity_texts(text):
    return [(k, text[s:e]) for k, s, e in pii.entities(text, pii.train())]


def test_entities_of_many_tokens_are_whole():
    for iban in ("DE89 3704 0044 0532 0130 00", "FR76 3000 6000 0112 3456 7890 189"):
        assert entity_texts(f"pay to {iban} today") == [("iban", iban)]
    for phone in ("+33 1 23 45 67 89", "+33 6 12 34 56 78"):
        assert entity_texts(f"call {phone} today") == [("phone", phone)]


def test_long_tokens_are_scored():
    r = random.Random(5)
    long = lambda n: "".join(r.choice("abcdefghijkLMNOPQ0123456789_-") for _ in range(n)) + "x"
    for secret in (f"eyJ{long(36)}.eyJ{long(600)}.{long(350)}", f"token={long(1000)}"):
        assert entity_texts(f"send {secret} along") == [("secret", secret)]
    assert entity_texts("see 1.2.3." + "4" * 5000 + " and 1.2.3.\u00b2 here") is not None


def test_entities_within_tokens():
    mail = ("email", "jane@x.org")
    for text in ("(jane@x.org)", "<jane@x.org>", "mailto:jane@x.org", '"jane@x.org"', "*jane@x.org*", "\u96fb\u8a71jane@x.org\u307e\u3067"):
        assert entity_texts(f"write to {text} now") == [mail], text
    assert entity_texts("to a@b.org,c@d.org now") == [("email", "a@b.org"), ("email", "c@d.org")]
    assert entity_texts('{"email":"a@b.org","phone":"212-555-0147"}') == [("email", "a@b.org"), ("phone", "212-555-0147")]
    assert entity_texts("open http://10.20.30.40/x now") == [("ip", "10.20.30.40")]


def test_decoding_of_cut_tokens_is_that_of_all_segmentations():
    model, r = pii.train(), np.random.default_rng(4)
    for text in ("(a@b.org,", '"1":"', "<1 2>", "a=1,", "t:4 (5)"):
        toks, before = next(iter(pii.runs(text)))
        toks = toks[:4]
        segs = pii.segments(text, toks, before)
        noisy = pii.Model(model.names, model.w + r.normal(0, 1, model.w.shape), model.a + r.normal(0, 1, model.a.shape))
        best = max(all_segmentations(len(toks), segs), key=lambda w: worth(noisy, segs, w))
        assert noisy.decode(len(toks), segs) == [(x, y) for x, y in best if x is not None]


def test_secrets_after_keywords_and_ibans_with_letters():
    for text in ("password: correcthorsebattery", "my password correcthorsebattery is old", '{"password":"correcthorsebattery"}'):
        assert entity_texts(text) == [("secret", "correcthorsebattery")], text
    for iban in ("GB29 NWBK 6016 1331 9268 19", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "SC18 SSCB 1101 0000 0000 0000 1497 USD"):
        assert entity_texts(f"pay to {iban} today") == [("iban", iban)]
    for text in ("the password reset page", "a secret garden", "key words and tokens of it"):
        assert entity_texts(text) == []


def test_texts_without_digits_are_read(spark):
    rows = [(1, "password: correcthorsebattery"), (2, "plain words")]
    assert [(r.doc_id, r.kind) for r in pii.find_pii(docs_of(spark, rows)).collect()] == [(1, "secret")]


# language identification


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        c = lid.codewords(n)
        apart = min((a != b).sum() for a, b in itertools.combinations(c, 2))
        assert len({tuple(x) for x in c}) == n and apart >= (1 if n == 2 else c.shape[1] // 3)


@pytest.fixture(scope="module")
def model_and_held(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = docs.filter("crc32(CAST(doc_id AS STRING)) % 10 < 5")
    return lid.train(seen, per_class=200), docs.join(seen.select("doc_id"), "doc_id", "left_anti")


def test_languages_of_held_out_documents(model_and_held):
    model, held = model_and_held
    got = held.join(lid.identify(held, model), "doc_id").filter("n_chars > 40").select("lang", "language", "ambiguous").toPandas()
    right = got["lang"] == got["language"]
    assert right.mean() > 0.95
    sure = got[~got["ambiguous"]]
    assert (sure["lang"] == sure["language"]).mean() >= right.mean()


def test_decoding_takes_the_codeword_of_the_least_loss(model_and_held):
    import pyarrow as pa

    model, held = model_and_held
    x = lid.features(pa.array([r.text for r in held.limit(50).collect()]))
    loss = model.losses(x)
    for row, f in zip(loss, x @ model.w + model.b):
        for k, c in enumerate(model.code):
            want = sum(w * math.log1p(math.exp(-v * b)) for v, b, w in zip(f, c, model.weight)) / model.weight.sum()
            assert row[k] == pytest.approx(want, rel=1e-4)


def test_languages_of_awkward_rows(spark, model_and_held, tmp_path):
    got = lid.identify(docs_of(spark, ODD), model_and_held[0]).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (1, 2, 3, 4, 5):
            assert r.language is None and r.ambiguous
    assert lid.identify(docs_of(spark, []), model_and_held[0]).count() == 0
    assert [r.language for r in lid.identify(docs_of(spark, [(1, "\u2014 100 \u20ac \u2026 12%")]), model_and_held[0]).collect()] == [None]
    for docs in (docs_of(spark, []), docs_of(spark, [(1, "text")]), docs_of(spark, [(1, "\u2014 100 \u20ac", "en")])):
        none = lid.train(docs)
        assert none.languages == [] and [(r.language, r.ambiguous) for r in lid.identify(docs, none).collect()] == [(None, True)] * docs.count()
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert lid.query(spark, str(tmp_path)).count() == 0


def test_bound_of_the_fit_holds_for_equal_ids(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(lid, "fit", lambda x, y: fitted.append(sorted(y)))
    same = [(1, f"the text {k % 9} of one", "en") for k in range(90)] + [(k, "der Text ist einer", "de") for k in range(3)]
    lid.train(docs_of(spark, same), per_class=5)
    assert fitted == [["de"] * 3 + ["en"] * 5]


def test_query_is_brute_force(spark, tmp_path):
    """Hashed n-grams counted one by one, losses of all codewords, for every row of a small table."""
    vocabulary = {"en": "the of and stone river word".split(), "de": "der und ist stein fluss wort".split(), "fr": "le et est pierre fleuve mot".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(30)), k) for i, k in enumerate(list(vocabulary) * 12)] + [(90, None, "en"), (91, "", None), (92, "le fleuve", None), (92, "le fleuve", None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    model = lid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = []
    for i, t, _ in rows:
        if not t:
            want.append((i, None))
            continue
        b, count = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in t.encode()), [0.0] * lid.DIM
        for w in (1, 2, 3):
            for at in range(len(b) - w + 1):
                g = b[at : at + w]
                if w > 1 and g[0] == 32 and g[-1] == 32:
                    continue
                v = int.from_bytes(g, "little")
                if w == 1:
                    h = v * 0x9E3779B1 % 2**32 >> 20
                else:
                    h = (v ^ (w << 28) % 2**32) * 0x85EBCA6B % 2**32
                    h = (h ^ (h >> 13)) * 0xC2B2AE35 % 2**32 >> 20
                count[h] += 1
        f = np.sqrt(np.array(count) / sum(count)) @ model.w + model.b
        loss = [float((np.log1p(np.exp(-f * c)) * model.weight).sum()) for c in model.code]
        want.append((i, model.languages[loss.index(min(loss))]))
    got = lid.query(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.language) for r in got), key=repr) == sorted(want, key=repr)


# decontamination


def bench_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, doc_id string, __id string")


def leaks():
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 8, 30])))) for i in range(12)] + [(50, "tiny"), (51, None), (52, ""), (53, "one two three")]
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            v = (items[i % 12][1]).split()
            for _ in range(rng.randint(0, len(v) // 8)):
                v[rng.randrange(len(v))] = "changed"
            t = t + " " + " ".join(v).upper() + ". " + t
        rows.append((i, t))
    return rows + [(70, None), (71, ""), (72, "tiny, indeed"), (73, "one two")], items


@pytest.mark.parametrize("local_grams", [10**6, 0])
def test_leaks_are_those_of_all_windows(spark, local_grams):
    rows, items = leaks()
    got = dec.contaminated(docs_of(spark, rows), bench_of(spark, items), local_grams=local_grams).collect()
    found = sorted((r["__id"], r.item_id, r.n_shared, r.n_grams) for r in got)
    assert found == held_items(rows, [(i, t) for i, t in items if t]) and len(found) > 10


@pytest.mark.parametrize("local_grams", [10**6, 0])
def test_leaks_of_awkward_rows(spark, local_grams):
    odd = ODD
    part = " ".join(LONG.split()[70_000:70_040])
    b = bench_of(spark, [(1, "one"), (1, "one"), (2, "a text without an id"), (3, part), (None, "one")])
    got = dec.contaminated(docs_of(spark, odd), b, local_grams=local_grams).collect()
    assert sorted(((r["__id"], r.item_id) for r in got), key=repr) == sorted([(6, 1), (7, 1), (7, 1), (8, 3), (9, 3), (None, 2)], key=repr)
    kept = dec.decontaminate(docs_of(spark, odd), b, local_grams=local_grams)
    assert kept.count() == len(odd) - 6 and kept.columns == docs_of(spark, odd).columns
    for docs, items in ((docs_of(spark, []), b), (docs_of(spark, odd), bench_of(spark, []))):
        assert dec.contaminated(docs, items, local_grams=local_grams).count() == 0


def test_windows_are_those_of_all_begins_in_linear_time():
    for _ in range(300):
        size, length = rng.randint(3, 12), rng.randint(1, 40)
        hits = sorted({(rng.randrange(length), rng.randrange(4)) for _ in range(rng.randint(1, 30))})
        near = sorted({h for h, _ in hits if rng.random() < 0.3})
        last, want = max(0, length - size), (0, 0)
        for p in sorted({min(h, last) for h, _ in hits}):
            k = len({g for h, g in hits if p <= h <= p + size - 3})
            if k > want[0] and any(p <= q <= p + size - 3 for q in near):
                want = (k, p)
        assert dec.best_window(hits, size, 3, length, near) == want
    took = []
    for n in (20_000, 80_000):
        hits = [(i, i % 7) for i in range(n)]
        began = time.process_time()
        assert dec.best_window(hits, 5000, 3, n, list(range(0, n, 2))) == (7, 0)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


# the salvage reader


def records(data, **how):
    return [(x[1], x[2]) for x in warc.salvage(data, **how) if x[0] == "record"]


def capture():
    parts = [warc.write_record("response", f"urn:{i}", f"http://a/{i}", rng.randbytes(rng.randint(0, 400)) + b"WARC/1.1\r\n\x1f\x8b\x08", packed=i % 3 > 0) for i in range(12)]
    return parts, np.cumsum([0, *map(len, parts)])


def test_all_records_of_a_member_are_read():
    import gzip

    parts = [warc.write_record("response", f"urn:{i}", "u", b"block %d" % i, packed=False) for i in range(5)]
    one = warc.write_record("response", "urn:9", "u", b"after")
    data = gzip.compress(b"".join(parts)) + one
    got = list(warc.salvage(data))
    assert [(x[0], x[4]) for x in got] == [("record", b"block %d" % i) for i in range(5)] + [("record", b"after")]
    assert sum(x[2] for x in got) == len(data) and got[-1][1] == len(data) - len(one)
    broken = gzip.compress(parts[0] + parts[1][9:] + parts[2])
    got = list(warc.salvage(broken))
    assert [x[4] for x in got if x[0] == "record"] == [b"block 0", b"block 2"]
    assert [x[1:3] for x in got if x[0] == "gap"] == [(0, 0)]
    assert [x[0] for x in warc.salvage(gzip.compress(b"rubbish"))] == ["gap"]


def test_whole_files_are_read_whole():
    parts, at = capture()
    assert records(b"".join(parts)) == [(int(a), len(p)) for a, p in zip(at, parts)]
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("k", range(12))
def test_a_broken_record_costs_only_itself(k):
    parts, at = capture()
    p = bytearray(parts[k])
    if k % 3:
        p[len(p) - 5] ^= 0xFF
    else:
        p[2] ^= 0xFF
    data = b"".join([*parts[:k], bytes(p), *parts[k + 1 :]])
    assert records(data) == [(int(a), len(q)) for i, (a, q) in enumerate(zip(at, parts)) if i != k]
    gaps = [(x[1], x[2]) for x in warc.salvage(data) if x[0] == "gap"]
    assert gaps == [(int(at[k]), len(p))]


def test_records_and_gaps_cover_every_byte():
    for seed in range(30):
        r = random.Random(seed)
        parts, _ = capture()
        data = bytearray(b"".join(parts))
        for _ in range(6):
            i = r.randrange(len(data))
            data[i : i + r.randint(1, 30)] = r.randbytes(r.randint(0, 30))
        at = 0
        for x in warc.salvage(bytes(data)):
            assert x[1] == at
            at += x[2]
        assert at == len(data)


def test_ranges_give_the_same_records(spark, tmp_path):
    parts, _ = capture()
    data = b"".join([*parts[:4], b"rubbish" * 9, *parts[4:8], parts[8][:20], *parts[9:]])
    (tmp_path / "a.warc").write_bytes(data)
    whole = [(x[0], x[1], x[2]) for x in warc.salvage(data)]
    for size, path in ((64, "a.warc"), (300, "a.warc"), (10**6, "a.warc"), (300, "file://")):
        read = warc.read_warc(spark, [f"file://{tmp_path}/a.warc" if ":" in path else str(tmp_path / path)], size).cache()
        assert sorted((r.byte_offset, r.byte_length) for r in read.filter("kind = 'record'").collect()) == sorted((a, n) for k, a, n in whole if k == "record")
        covered = sum(r.byte_length for r in warc.whole_gaps(read).collect())
        assert covered == sum(n for k, _, n in whole if k == "gap")
        read.unpersist()


def plain_reader(data):
    """Records of a file by trying every byte, from a reader that knows nothing but the formats."""
    import base64
    import gzip
    import hashlib
    import io

    def plain(b):
        head, end, rest = b.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not end or not lines[0].startswith(b"WARC/") or lines[0][5:].count(b".") != 1 or not lines[0][5:].replace(b".", b"").isdigit():
            return None
        h = {}
        for line in lines[1:]:
            k, colon, v = line.partition(b":")
            if not colon:
                return None
            h[k.strip().lower()] = v.strip()
        n = h.get(b"content-length", b"-")
        if not n.isdigit() or b"warc-type" not in h or rest[int(n) : int(n) + 4] != b"\r\n\r\n":
            return None
        block, said = rest[: int(n)], h.get(b"warc-block-digest", b"")
        if said.startswith(b"sha1:") and said[5:] != base64.b32encode(hashlib.sha1(block).digest()):
            return None
        return len(head) + 4 + int(n) + 4, block

    out, at = [], 0
    while at < len(data):
        b = data[at:]
        got = plain(b)
        if not got and b.startswith(b"\x1f\x8b\x08"):
            for end in range(18, len(b) + 1):  # the shortest prefix that is a whole member
                try:
                    inner = gzip.GzipFile(fileobj=io.BytesIO(b[:end])).read()
                except (EOFError, OSError, zlib.error):
                    continue
                got = plain(inner)
                got = got and got[0] == len(inner) and (end, got[1])
                break
        if got:
            out.append((at, got[0], got[1]))
        at += got[0] if got else 1
    return out


def test_query_is_that_of_a_plain_reader(spark, tmp_path):
    import hashlib

    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(20)] + [(20, None, None), (None, "u", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.query(spark, str(tmp_path)).collect()
    found = sorted(((r.page_id, r.byte_offset, r.byte_length, r.block_sha256) for r in got if r.kind == "record"), key=repr)
    want = [(i, at, n, hashlib.sha256(block).hexdigest()) for i, u, h in rows for at, n, block in plain_reader(warc.damaged_capture(i, u, h))]
    assert found == sorted(want, key=repr)
    for i, u, h in rows:
        mine = [r for r in got if r.page_id == i]
        assert sum(r.byte_length for r in mine) == len(warc.damaged_capture(i, u, h))


def test_headers_versions_and_digests():
    long = b"WARC/0.18\r\nWARC-Type: response\r\nX: " + b"y" * 200_000 + b"\r\n folded\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (got,) = warc.salvage(long)
    assert got[:3] == ("record", 0, len(long)) and got[3]["x"].endswith("y folded") and got[4] == b"ok"
    block = b"some block"
    for said, fine in (("sha1:" + __import__("hashlib").sha1(block).hexdigest(), True), ("md5:" + "0" * 32, False), ("sha256:abc", False), ("crc:1", True), ("", True)):
        r = f"WARC/1.0\r\nWARC-Type: r\r\nWARC-Block-Digest: {said}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        assert [x[0] for x in warc.salvage(r)] == ["record" if fine else "gap"], said


def test_large_files_take_linear_time():
    one = warc.write_record("response", "urn:1", "u", rng.randbytes(3000))
    rubbish = [b"\x1f\x8b\x08" * 20_000, b"WARC/1.0\r\na: b\r\n" * 4000]
    for data, records in ((one, 1), *((x, 0) for x in rubbish)):
        took = []
        for n in (500, 2000) if records else (1, 4):
            began = time.process_time()
            got = list(warc.salvage(data * n))
            took.append(time.process_time() - began)
            assert sum(x[0] == "record" for x in got) == records * n and sum(x[2] for x in got) == n * len(data)
        assert took[1] < 8 * took[0] + 0.5, data[:10]


def test_contents_with_nulls_and_empty_tables(spark):
    schema = "page_id long, content binary, file string, kind string"
    one = warc.write_record("response", "urn:1", "u", b"block")
    d = spark.createDataFrame([(1, one + one, "x", "y"), (2, None, "x", "y"), (3, b"", "x", "y"), (None, b"rubbish", None, None)], schema)
    got = sorted(((r.file, r.kind, r.byte_offset, r.byte_length) for r in warc.read_contents(d, "page_id").collect()), key=repr)
    assert got == sorted([(1, "record", 0, len(one)), (1, "record", len(one), len(one)), (None, "gap", 0, 7)], key=repr)
    assert warc.read_contents(spark.createDataFrame([], schema), "page_id").count() == 0


def test_captures_of_pages_lose_only_what_is_damaged(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 20) for i in range(64)] + [(None, None, None)], "page_id long, url string, html string")
    got = warc.read_contents(warc.captures(pages), "page_id").filter("kind = 'record'").groupBy("file").count().collect()
    assert len(got) == 65 and all(r["count"] in (2, 3) for r in got)
    damaged = {i for i in [*range(64), None] if warc.DAMAGE[zlib.crc32(str(i).encode()) % 8] not in ("none", "rubbish before")}
    assert {r.file for r in got if r["count"] == 2} == damaged
