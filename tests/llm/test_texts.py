"""Operators over whole texts: packing, quality, language, audio, licences; small odd tables and brute force."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import chat_format, language_id, licenses, media, packing, quality, queries

LONG = "long text here. " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, "same text twice"), (7, "same text twice"), (7, "same text twice"), (None, "no id"), (8, "<|endoftext|> é 漢字 \U0001f600 \x00 tab\tend")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' as curve", "1 as stats", "'y' as `N_Lines`", "cast(null as string) as lang", "0 as w")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_hilbert_curve_steps_are_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


VOCABULARY = {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "added": packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))}


def check_packing(rows, texts):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(reference.encode(text or "", add_special_tokens=False).ids + [1])
    assert set(pieces) == set(want)
    for doc, lists in want.items():
        got = sorted((p.start, bytes(p.ids)) for p in pieces[doc])
        assert sum(len(x) // 4 for _, x in got) == sum(map(len, lists))
        assert {p.doc_tokens for p in pieces[doc]} == set(map(len, lists))
        if len(lists) == 1:
            assert b"".join(x for _, x in got) == struct.pack(f"<{len(lists[0])}I", *lists[0])
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    # little padding: nearly all sequences are full
    total = sum(len(x) for lists in want.values() for x in lists)
    assert len(sequences) <= total // 2048 + 11 * (1 + max(sequences, default=0) // (1 << 36) + 1)


def test_packing_holds_every_id_once(odd, spark, sf):
    check_packing(packing.pack_documents(odd, **VOCABULARY).collect(), ODD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check_packing(packing.pack_documents(docs, **VOCABULARY).collect(), [tuple(r) for r in docs.collect()])
    assert packing.pack_documents(odd.limit(0), **VOCABULARY).count() == 0


def test_stretches_have_like_bytes(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH_BYTES", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copies = spark.range(100).selectExpr("id + 10000 as doc_id", "repeat('copy of one text ', 200) as text")
    rows = packing.pack_documents(docs.union(copies), **VOCABULARY).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id >> 36] += r.length
    longest = max(r.doc_tokens for r in rows)
    assert len(held) > 10 and max(held.values()) < longest + 4 * sum(held.values()) / len(held)
    check_packing(rows, [tuple(r) for r in docs.union(copies).collect()])


@pytest.mark.parametrize("seed", range(5))
def test_stretches_by_sorted_cuts(seed):
    r = np.random.default_rng(seed)
    cuts = np.array(sorted(map(tuple, r.integers(0, 5, (6, 2)).tolist())))
    curve, doc = r.integers(0, 5, 50), r.integers(0, 5, 50)
    assert packing._stretches(curve, doc, cuts).tolist() == [sum(tuple(c) <= (a, b) for c in cuts.tolist()) for a, b in zip(curve, doc, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_rank_file_gives_the_ids_of_the_tokenizers_file(text):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert own.encode_to_numpy(text, disallowed_special=()).tolist() == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "\n", "a b", "é 漢字", "'s 12", "<|"]), max_size=8).map("".join))
def test_added_tokens_are_matched_in_texts(text):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple(added.items()))
    assert own.encode_to_numpy(text, allowed_special="all", disallowed_special=()).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_query_gives_added_tokens(spark, tmp_path):
    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text), (2, "plain")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [1]
    rows = queries.op1_curve_packing(spark, str(tmp_path)).filter("doc_id = 1").collect()
    assert {r.doc_tokens for r in rows} == {len(ids)} == {sum(r.length for r in rows)}
    if len(rows) == 1:
        assert rows[0].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_quality_learns_from_labels(spark):
    rows = queries.op5_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = rows.filter("held_out").join(labels, "doc_id").selectExpr("avg(int(predicted = quality)) as a").first().a
    assert right > 0.93


def plain_statistics(text):
    """The statistics of one text by Python's own means."""
    data, words = text.encode(), re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    n, size = max(len(words), 1), max(len(data), 1)
    upper, lower = (lambda c: "A" <= c <= "Z" or "\xc0" <= c < "\xdf"), (lambda c: "a" <= c <= "z" or "\xdf" <= c <= "\xff")
    letters = [c for c in text if upper(c) or lower(c)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    angle = lambda a, b: math.asin(math.sqrt(min(1, a / max(b, 1))))
    shape = [[c for c in w.decode() if upper(c) or lower(c)] for w in words]
    caps = [x for x in shape if len(x) >= 2 and all(map(upper, x))]
    packed = len(zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False).compress(data))
    return [
        math.log1p(len(words)), math.log1p(len(data) / n), angle(sum(map(upper, letters)), len(letters)), math.sqrt(text.count("!") / n),
        angle(sum("!" <= c <= "~" and not c.isalnum() and c not in ".,!" for c in text), size), angle(sum("0" <= c <= "9" for c in text), size), math.sqrt(text.count("\n") / n),
        len(set(words)) / max(math.sqrt(len(words)), 1) / 10, angle(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)), angle(len(set(grams)), len(grams)),
        math.log((packed + 20) / (len(data) + 20)), math.log1p(max(map(len, ("\n" + text).encode().split(b"\n")[1:])) + 1 if text else 1), angle(len(caps), len(words)), angle(sum(not x for x in shape), len(words)),
    ]


def test_quality_by_plain_statistics_and_solves(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = {i: np.array(plain_statistics(t)) for i, t in docs}
    assert np.allclose(quality.statistics([t.encode() for _, t in docs]), np.array([x[i] for i, _ in docs]), atol=1e-9)
    logs = []
    for c in (0, 1):
        own = np.array([x[i] for i, _ in docs if labels.get(i) == c])
        mean, d = own.mean(axis=0), own.shape[1]
        cov = (own - mean).T @ (own - mean) / len(own)
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        logs.append({i: -0.5 * (v - mean) @ np.linalg.solve(cov, v - mean) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(len(own)) for i, v in x.items()})
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    for i, _ in docs:
        p = 1 / (1 + math.exp(min(50, max(-50, logs[0][i] - logs[1][i]))))
        assert abs(got[i].score - p) < 1e-5 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_of_odd_rows_and_missing_labels(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (99, 1)], "doc_id long, quality int")
    scores = quality.score_documents(odd, labels)
    assert scores.count() == len(ODD) and scores.filter("score between 0 and 1").count() == len(ODD)
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(odd, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.score_documents(empty, labels).count() == 0
    model = quality.fit(quality.document_statistics(odd), labels)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)


def test_statistics_of_a_text_do_not_hang_on_its_neighbours():
    texts = [b"One two two.", b"", LONG[:5000].encode(), "ÉTÉ!! x\ny".encode()]
    alone = np.vstack([quality.statistics([t]) for t in texts])
    assert np.allclose(quality.statistics(texts), alone)


def test_language_by_compression(spark, odd, empty):
    rows = queries.op6_compression_language(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert rows.filter("held_out").join(lang, "doc_id").selectExpr("avg(int(lang = lang_pred)) as a").first().a > 0.97
    learnt = {"aa": b"the word and the text of this", "bb": b"der die das und nicht"}
    found = language_id.identify(odd, learnt).collect()
    assert len(found) == len(ODD)
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.learn(empty) == {} and language_id.learn(odd) == {}
    assert language_id.identify(empty, learnt).count() == 0


def test_language_by_a_plain_loop(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("crc32(cast(doc_id as string)) % 4 <> 2")
    words = language_id.learn(docs)
    assert set(words) == {r.lang for r in rows if r.lang} and all(0 < len(w) <= 98_304 for w in words.values())
    got = {r.doc_id: r for r in queries.op6_compression_language(spark, sf).collect()}
    for r in rows[:60]:
        data, sizes = (r.text or "").lower().encode(), {}
        for lang, w in words.items():
            squeeze = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(w.ljust(16, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(squeeze.compress(data[i : i + 2048])) for i in range(0, len(data), 2048))
        best = min(sizes, key=lambda k: (sizes[k], k)) if any(map(str.isalpha, r.text or "")) else "und"
        assert got[r.doc_id].lang_pred == best
        if best != "und":
            least, second = sorted(sizes.values())[:2]
            assert got[r.doc_id].rejected == ((second - least) / least < 0.01)


def test_languages_on_a_tie_and_too_many(spark):
    docs = spark.createDataFrame([(i, "some words to learn", f"l{i % 7}") for i in range(40)], "doc_id long, text string, lang string")
    assert sorted(language_id.learn(docs, max_languages=3)) == ["l0", "l1", "l2"]
    found = language_id.identify(docs, {"b": b"same words here", "a": b"same words here"}).collect()
    assert {(r.lang_pred, r.rejected, r.score) for r in found} == {("a", True, 0.5)}


def adpcm_by_hand(data, block):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        value, index = struct.unpack("<h", b[:2])[0], min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for nibble in (byte & 15, byte >> 4):
                step, change = int(media.STEPS[index]), int(media.STEPS[index]) >> 3
                change += step * (nibble >> 2 & 1) + (step >> 1) * (nibble >> 1 & 1) + (step >> 2) * (nibble & 1)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX[nibble & 7])))
                out.append(value)
    return out


def test_telephony_codecs():
    mu, a = media.TABLES[media.MU_LAW], media.TABLES[media.A_LAW]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    data = np.random.default_rng(1).integers(0, 256, 64 * 5 + 20, dtype=np.uint8).tobytes()
    assert media.decode_adpcm(data, 64).tolist() == adpcm_by_hand(data, 64)
    for codec, block in ((media.MU_LAW, 1), (media.A_LAW, 1), (media.ADPCM, 64)):
        assert media.read_wav(media.wav(data, codec, 8000, block)) == (codec, 8000, block, data)
    assert media.resample(np.array([0, 10, 20], dtype=np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]


def test_media_round_trip(spark, odd, empty):
    texts = [*ODD, *((100 + i, f"text {i} " * (i % 9)) for i in range(40))]
    docs = spark.createDataFrame(texts, SCHEMA)
    rows, codecs = media.decode_telephony(media.store_texts(docs)).collect(), set()
    for (_, text), r in zip(sorted(texts, key=repr), sorted(rows, key=lambda r: repr((r.doc_id, dict(texts)[r.doc_id]))), strict=True):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        file = media.wav(padded, r.codec, block=64 if r.codec == media.ADPCM else 1)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        pcm = adpcm_by_hand(padded, 64) if r.codec == media.ADPCM else [int(media.TABLES[r.codec][b]) for b in padded]
        wide = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for x in (a, (a + b) >> 1)]
        assert bytes(r.pcm) == struct.pack(f"<{len(wide)}h", *wide)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
        assert r.feature == f"n={len(wide)};peak={max(map(abs, wide))};ms={sum(x * x for x in wide) // len(wide)};zc={crossings};crc={zlib.crc32(bytes(r.pcm))}"
        codecs.add(r.codec)
    assert codecs == {media.MU_LAW, media.A_LAW, media.ADPCM}
    assert len({(r.payload_sha256, r.feature) for r in rows if r.doc_id in (6, 7)}) == 1
    assert media.decode_telephony(media.store_texts(empty)).count() == 0
    assert media.decode_telephony(media.store_texts(odd), keep_pcm=False).columns[-1] == "feature"
    broken = spark.createDataFrame([(1, None), (2, b"no wav")], "doc_id long, media binary")
    assert all(r.codec is None and r.feature is None for r in media.decode_telephony(broken).collect())


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<|x", "\\"]), st.text(alphabet="<|\\im_end>start \nab", max_size=25)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_chat_format_reads_back(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count(chat_format.END) == len(turns)


def test_layouts_by_fingerprint(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', "messages"),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"ho"}]}', "conversations"),
        (3, '{"instruction":"add","input":"1 2","output":"3"}', "instruction"),
        (4, '{"prompt":"hi","response":"ho"}', "prompt"),
        (5, '{"what":1}', None), (6, "no json", None), (7, None, None), (8, "[1]", None), (9, '{"messages":[]}', "messages"),
    ]
    out = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame([x[:2] for x in rows], "conv_id long, record string")).collect()}
    assert {i: out[i].layout for i, _, _ in rows} == {i: name for i, _, name in rows}
    assert chat_format.parse(out[2].formatted) == [("user", "hi"), ("assistant", "ho")]
    assert chat_format.parse(out[3].formatted) == [("user", "add\n\n1 2"), ("assistant", "3")]


def test_layouts_leave_further_fields_out(spark):
    user, both = [("user", "hi")], [("user", "hi"), ("assistant", "ho")]
    rows = [
        ('{"id": 7, "messages": [{"role": "user", "content": "hi", "name": "Ann"}], "meta": {"a": [1]}}', "messages", user),
        ('{"instruction": "hi", "output": "ho", "source": "web", "input": ""}', "instruction", both),
        ('{"system": "be kind", "conversations": [{"from": "human", "value": "hi", "weight": 1}]}', "conversations", [("system", "be kind"), *user]),
        ('{"prompt": "hi", "messages": [{"role": "user", "content": "hi"}]}', "messages", user),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "url": "x"}, {"type": "text", "text": "you"}]}]}', "messages", [("user", "hi\\nyou")]),
        ('{"messages": [{"role": "user", "content": [{"type": "image", "url": "x"}]}, {"role": "assistant", "content": null}]}', "messages", [("user", ""), ("assistant", "")]),
        ('{"messages": [{"role": "user", "text": "hi"}]}', None, []),
        ('{"messages": "hi"}', None, []),
        ('{"messages": [{"role": "user", "content": 7}]}', None, []),
        ('{"system": null, "question": "hi", "answer": "ho", "id": null}', "question", both),
    ]
    table = spark.createDataFrame([(i, r.replace("\\\\n", "\\n")) for i, (r, _, _) in enumerate(rows)], "conv_id long, record string")
    formatted = chat_format.format_chats(table)
    for r in formatted.collect():
        _, layout, turns = rows[r.conv_id]
        assert (r.layout, chat_format.parse(r.formatted)) == (layout, [(a, b.replace("\\n", "\n")) for a, b in turns])
    assert sum(r.n for r in chat_format.unknown_layouts(formatted).collect()) == 3


def test_a_long_conversation(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "long text " * 300) for i in range(400)], "conv_id long, turn long, role string, text string")
    out = chat_format.digest(chat_format.format_chats(chat_format.records_from_turns(turns))).first()
    assert (out.n_turns, out.loss_chars) == (400, 200 * 3000)


def test_chat_of_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "user", "x"), (2, 1, "assistant", "<|im_end|>"), (None, 0, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as record", "2 as t")
    out = chat_format.digest(chat_format.format_chats(chat_format.records_from_turns(turns)))
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in out.collect()) == [(0, 1, 0), (1, 3, 2), (2, 2, 10)]
    assert chat_format.format_chats(chat_format.records_from_turns(turns.limit(0))).count() == 0


def test_license_notices(spark, odd, empty):
    text = "Intro words. " * 40 + licenses.NOTICES["gpl-3.0"] + " more " * 50 + "RELEASED under the MIT license"
    docs = spark.createDataFrame([*ODD, (50, text), (51, text.replace("General", "Special"))], SCHEMA).selectExpr("*", "1 as half", "2 as band")
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert found == {(50, "gpl-3.0"), (50, "mit"), (51, "mit")}
    assert licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd, {"short": "two words"})
