"""The pipeline's stages on a small table: decisions take effect and columns stay."""

import corpus_pipeline
from lorekeep.llm.common import cut


def test_stages(spark, tmp_path):
    from test_operators import SCHEMA, TEXTS, brute_components, brute_removed

    rows = [(i, t, "en", None, len(t or ""), -1, "clash", 9.9, "r") for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], "en", None, 1, -1, "clash", 9.9, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = cut(stage(spark, docs, str(tmp_path)), name)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == docs.columns
        if name == "quality":  # the row that is there twice passes or goes as one
            assert set(after) == {i for i, v in brute_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in before]).items() if v[-1]}
        elif name == "toxicity":  # one label trains nothing: all stay
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in before)
        else:
            assert out.count() == len(after)
        texts = {r["doc_id"]: r["text"] or "" for r in before}
        if name == "ngram_join":
            assert after.keys() == {k for k, (_, c) in brute_components(texts).items() if k == c}
        if name == "substring_dedup":
            assert after == {k: (v[2] if v[1] else texts[k]) for k, v in brute_removed(texts).items()}
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_on_files(spark, tmp_path):
    from test_operators import SCHEMA

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_verdicts(rows):
    """Per id piece rate, byte-level rate, byte-fallback share, entropy, band and verdict, by the two libraries."""
    import base64
    from collections import Counter
    from math import log2

    import sentencepiece
    import tiktoken
    from lorekeep.llm.queries import quality_files
    from lorekeep.llm.quality_rules import BANDS, KNOTS
    from test_operators import WORD

    files = quality_files()
    piece = sentencepiece.SentencePieceProcessor(model_file=files["piece_model"])
    with open(files["byte_ranks"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    level = tiktoken.Encoding("own", pat_str=files["pattern"], mergeable_ranks=ranks, special_tokens={})
    out = {}
    for doc_id, text, lang in rows:
        words = WORD.findall(text or "")
        ids = [i for w in words for i in piece.encode(w)]
        n, chars = len(ids), sum(map(len, words))
        rates = chars / max(n, 1), chars / max(sum(len(level.encode_ordinary(" " + w)) for w in words), 1)
        share = sum(piece.is_byte(i) for i in ids) / max(n, 1)
        bits = -sum(c / n * log2(c / n) for c in Counter(ids).values())
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
        band = lang if lang in ("en", "de", "fr", "es") else "latin" if any(c.isascii() and c.isalpha() for c in text or "") else "other"
        piece_ends, level_ends, most, weight, least, marks = BANDS[band]
        at = min(max(log2(max(n, 1)), KNOTS[0]), KNOTS[-1])
        k = min(int(at), KNOTS[-2]) - KNOTS[0]
        floor = least[k] + (at - KNOTS[k]) * (least[k + 1] - least[k])
        kept = len(words) >= 50 and 2 * len(hit) <= len(words) and share <= most and bits + weight * rates[1] >= floor
        kept = kept and all(a <= x <= b for x, (a, b) in zip(rates, (piece_ends, level_ends), strict=True)) and sum(c in "#*$%&|<>" for c in text) <= marks * len(words)
        out[doc_id] = (*rates, share, bits, band, kept)
    return out


def test_quality_measures_and_stage(spark, tmp_path):
    import pytest
    from lorekeep.llm import quality_rules
    from lorekeep.llm.queries import quality_files
    from test_operators import SCHEMA, TEXTS

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    found = docs.join(labels, "doc_id").where("length(text) > 400").orderBy("doc_id").collect()
    kinds = {"table": [r for r in found if r["quality"] == 0 and " | " in r["text"]], "noise": [r for r in found if r["quality"] == 0 and "%%%" in r["text"]], "good": [r for r in found if r["quality"] == 1]}
    chosen = [(r["text"], lang, kind) for kind, x in kinds.items() for r in x[:8] for lang in (r["lang"], None, "other")]
    assert len(chosen) == 72
    rows = [(i, t, lang) for i, (t, lang, _) in enumerate(chosen)] + [(100 + i, t, [None, "en"][i % 2]) for i, t in enumerate(TEXTS) if i != 19]
    table = spark.createDataFrame([(i, t, lang, None, 0, -1, "k", 0.0, "r") for i, t, lang in rows], SCHEMA)
    want = brute_verdicts(rows)
    got = {r["doc_id"]: r for r in quality_rules.judge(table, **quality_files()).collect()}
    for i, (*measures, band, kept) in want.items():
        r = got[i]
        assert [r["piece_chars_per_token"], r["byte_chars_per_token"], r["byte_fallback_share"], r["token_entropy"]] == pytest.approx(measures)
        assert (r["band"], r["kept"]) == (band, kept)
    assert all(not r["base_failed"] and r["kept"] == (chosen[i][2] == "good") for i, r in got.items() if i < 100)
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, table, str(tmp_path)).collect()} == {i for i, x in want.items() if x[-1]}


def test_toxicity_stage_rejects_toxic_rows_and_keeps_clean_ones(spark, tmp_path):
    from test_operators import SCHEMA, prose

    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(i, 60).split(" "), i % 4 == 0
        for p in (5, 25, 45) if toxic else ():
            words[p] = ("vilebad", "vileworse", "Nasty,")[(i + p) % 3]
        rows.append((i, " ".join(words), "en", None, 0, -1, "k", 0.0, "r"))
        if i < 380:
            labels.append((i, 1, int(toxic)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert kept & set(range(380, 400)) == {i for i in range(380, 400) if i % 4}
    assert len(kept ^ {i for i in range(400) if i % 4}) <= 8
