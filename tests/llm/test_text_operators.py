"""URL filters, sharding, language ID, SentencePiece, token counts and license scans against brute force, with odd rows."""

import itertools
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.llm import language_id, license_scan, pieces, queries, sharding, sp_encode, token_count, url_filter

ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "12 34 ??", "en"), (5, "word", "fr"), (5, "word", "fr"), (6, "a" * 5000 + " end", "en"), (7, "日本語 ▁ x\u0000é  two  spaces ", "en"), (None, "null id", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "rule", "n_tokens", "slot", "n_pieces", "text_crc32")})


def test_url_filter(spark):
    urls = ["http://a.COM/x", "https://www.example.com/en/1", "http://example.com/en", "http://b.example.com/en/2?q", "ftp://x.net/es/1#a", "http://x.net", "net/fr/1", None, "http://", "a://b://c", "http://notexample.com/en/1", "http://x.net/fr/?/es/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = {r["page_id"]: r for r in url_filter.url_filter(df, queries.RULES).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
            host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *want), u
    assert url_filter.url_filter(df, []).filter("verdict <> 'allow'").count() == 0 and url_filter.url_filter(df.limit(0), queries.RULES).count() == 0
    for bad in ("../x", "/x", "com"):
        with pytest.raises(ValueError, match="not a rule"):
            url_filter.Rule(bad, "block")
    upper = url_filter.url_filter(df, [url_filter.Rule("X.Net/es/", "block")]).filter("verdict = 'block'").collect()
    assert [(r["page_id"], r["rule"]) for r in upper] == [(4, "X.Net/es/")]
    star = url_filter.url_filter(df, [url_filter.Rule("com/*/1", "block")])
    assert [r["page_id"] for r in star.filter("verdict = 'block'").orderBy("page_id").collect()] == [1, 10]


def test_sharding(spark, odd, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op3_sharding(spark, sf_dir).toPandas()
    assert len(out) == docs.count() and out.law.eq("key").all() and out.shard.between(0, 39).all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and len(own) < 4 * len(out) / 40
    moved = out[out.shard != out.grown_shard]
    assert (moved.grown_shard == 40).all() and len(moved)
    text = docs.toPandas().set_index("doc_id").text
    assert all(zlib.crc32(text[i].encode()) == c and len(text[i].encode()) + 16 == n for i, c, n in zip(out.doc_id, out.text_crc32, out["size"], strict=True))
    again = queries.op3_sharding(spark, sf_dir).toPandas()
    assert out.sort_values("doc_id").slot.tolist() == again.sort_values("doc_id").slot.tolist()
    small = sharding.external_shuffle(docs, 3, bucket_bytes=4000)
    assert small.select("shard", "bucket").distinct().count() > 3
    for _, own in small.select("shard", "slot").toPandas().groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sharding.write_shards(small, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
    few = sharding.external_shuffle(odd, 2)
    assert few.count() == len(ODD) and few.filter("doc_id = 1").first()["size"] == 16 and few.filter("doc_id = 1").first()["text_crc32"] is None
    assert sharding.external_shuffle(odd.limit(0), 2).count() == 0


@lru_cache
def vocab():
    return pieces.vocabulary(pieces.DEFAULT_MODEL)


def plain_viterbi(text):
    """Exhaustive in the end position, with the same tie rule, over the whole text at once."""
    v, t = vocab(), " " + text
    best, back = [0.0] + [-np.inf] * len(t), [0] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - v.longest), end):
            s = v.scores.get(t[start:end], v.unknown if end - start == 1 else None)
            if s is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    out, end = [], len(t)
    while end:
        p = t[back[end] : end]
        out = ([v.ids[p]] if p in v.ids else v.spell(p)) + out
        end = back[end]
    return out


def test_sentencepiece(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sp_encode.encode_decode(docs).toPandas()
    assert out.round_trip.all() and len(out) == docs.count()
    for t, ids in zip(out.text[:25], out.piece_ids[:25], strict=True):
        assert list(ids) == plain_viterbi(t[:3000]) if len(t) <= 3000 else True
    rows = {i: r for i, r in enumerate(sp_encode.encode_decode(odd).collect())}
    for r in rows.values():
        if r["text"] is None:
            assert r["piece_ids"] is None and r["n_pieces"] == 0 and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])
            assert list(r["piece_ids"]) == (plain_viterbi(r["text"]) if r["text"] else [])
    back = sp_encode.decode(sp_encode.encode(odd)).filter("text is not null")
    assert back.filter("decoded <> text").count() == 0 and back.count() == len(ODD) - 1
    assert sp_encode.encode_decode(odd.limit(0)).count() == 0


def test_viterbi_is_best():
    v, own = vocab(), sp_encode.viterbi(pieces.DEFAULT_MODEL)
    for word in (" there", " andthe", "été", " \u2581a", "日本x"):
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            if all(p in v.scores or len(p) == 1 for p in parts):
                best = max(best, sum(v.scores.get(p, v.unknown) for p in parts))
        ids = np.frombuffer(own.segment([word], len(word))[0], np.int32).tolist()
        spelled = [c for c in word if c not in v.ids]
        score = sum(v.scores[s] for s in (v.strings[i].decode("utf-8", "ignore") for i in ids) if s in v.scores)
        assert np.frombuffer(own.segment_one(word), np.int32).tolist() == ids
        if not spelled:
            assert score == best


def test_token_count(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a = token_count.token_count(docs).select("doc_id", "n_tokens").toPandas().set_index("doc_id").n_tokens
    b = sp_encode.encode(docs).select("doc_id", "n_pieces").toPandas().set_index("doc_id").n_pieces
    assert (a == b.loc[a.index]).all()
    for r in token_count.token_count(odd).collect():
        assert r["n_tokens"] == (len(plain_viterbi(r["text"])) if r["text"] else 0)
    assert token_count.token_count(odd.limit(0)).count() == 0


def test_language_id(spark, odd, sf_dir):
    out = language_id.label(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"))
    t = out.toPandas()
    assert (t.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in t.doc_id]).all()
    held = t[t.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and t.score.between(0, 1).all()
    assert set(language_id.accuracy(out).lang) == set(held.lang)
    model = language_id.fit(out.filter("not held_out"))
    for r in language_id.predict(odd, model).collect():
        if not r["text"] or r["doc_id"] in (3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in set(t.lang) and 0 <= r["score"] <= 1
    seen = np.abs(model.weights).sum(1) > 0
    texts = " ".join(t.text.dropna())
    assert 0.3 < (model.weights[language_id.counted(texts)[0]] == 0).mean() < 0.95 and seen.any()  # sparse
    assert language_id.fit(odd.filter("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.label(odd.limit(0)).count() == 0


def test_language_features():
    """Counted in pieces or at once, against n-grams taken one by one."""
    text = "Ünïcode " * 40 + "x"
    whole = language_id.counts_of(text)
    grams = [" " + text.lower() + " "]
    assert whole.sum() == sum(len(grams[0]) - n for n in range(3))
    before, language_id.PIECE = language_id.PIECE, 7
    try:
        assert (language_id.counts_of(text) == whole).all() and (language_id.counts_of("é") == language_id.counts_of("É")).all()
    finally:
        language_id.PIECE = before


def test_license_scan(spark, odd):
    texts = {
        10: "x\nReleased under the MIT License.\ny", 11: "Licensed under the Apache License, Version 2.0.", 12: "licensed under the  apache license version 2.0", 13: "The license of poets.",
        14: "All rights reserved.", 15: license_scan.TEMPLATES["GPL-3.0/header"].replace("version 3", "version 2"), 16: "Foreword. " + license_scan.TEMPLATES["MIT/text"] + " Afterword of many words.",
        17: "Licensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(odd.select("doc_id", "text")).withColumn("line", F.lit("x"))
    rows = license_scan.license_scan(df).collect()
    got = {(r["doc_id"], r["line"]): (r["license"], r["exact"]) for r in rows}
    assert got == {(10, 2): ("MIT", True), (11, 1): ("Apache-2.0", True), (12, 1): ("Apache-2.0", True), (15, 1): ("GPL-2.0", True), (16, 1): ("MIT", True), (17, 1): ("Apache-2.0", True), (17, 3): ("MIT", True)}
    assert license_scan.license_scan(df.limit(0)).count() == 0
