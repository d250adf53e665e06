"""The corpus pipeline against a plain version of its stages."""

from collections import Counter

import corpus_pipeline as P
from clickpath.llm import line_dedup, queries
from tests.llm.test_near_duplicates import brute_force

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    clean = [[x.translate({9: 32, 13: 32, 11: 32, 12: 32}).strip(" ") for x in (t or "").split("\n")] for _, t, _ in rows]
    clean = [[x for x in own if x] for own in clean]
    pages, with_line = Counter(s for _, _, s in rows), Counter()
    for (_, _, s), own in zip(rows, clean):
        with_line.update((s, x) for x in set(own))
    drop = {k for k, n in with_line.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    return [(i, t if not any((s, x) in drop for x in own) else "\n".join(x for x in own if (s, x) not in drop), s)
            for (i, t, s), own in zip(rows, clean)]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.identify_language(spark, docs, SF)
    assert first.columns == docs.columns
    stay = {r.doc_id for r in first.collect()}
    judged = {r.doc_id: r for r in P.language_id.identify(docs, P.language_id.train(docs)).collect()}
    assert stay == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= P.LEAST_SCORE}
    assert len(stay) >= 0.98 * docs.count()

    second = P.drop_shared_lines(spark, first, SF)
    got = {(r.doc_id, r.text, r.source) for r in second.collect()}
    rows = [(r.doc_id, r.text, r.source) for r in first.collect()]
    assert second.columns == docs.columns and got == set(plain_lines(rows))
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = P.drop_near_duplicates(spark, second, SF)
    want = brute_force([(r.doc_id, r.text) for r in second.collect()], 5)
    assert third.columns == docs.columns
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, (_, c) in want.items() if i == c)

    fourth = P.mix_sources(spark, third, SF)
    times = Counter(r.doc_id for r in fourth.collect())
    taken = {r.doc_id: r for r in P.source_mix.mix(third).collect()}
    assert fourth.columns == docs.columns
    assert times == Counter({i: n for i, r in taken.items() if r["size"] and (n := -(-(2 * r.taken - r["size"]) // (2 * r["size"]))) > 0})


def test_edge_rows_pass_all_stages(spark, edge, empty):
    for docs in (edge, empty):
        for _, stage in P.STAGES:
            before, docs = docs.columns, stage(spark, docs, SF)
            if stage is not P.encode:
                assert docs.columns == before
        assert docs.count() >= 0
    near = P.drop_near_duplicates(spark, edge, SF).collect()
    assert Counter(r.doc_id for r in near)[11] == 1 and {5, 6} & {r.doc_id for r in near} == set()
    assert len([r for r in near if r.doc_id is None]) == 1


def test_whole_run_matches_its_stages_and_the_codec(spark):
    rows = P.run(spark, SF).collect()
    assert rows and {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(rows[0].asDict())
    assert all(r.n_tokens == len(r.ids) for r in rows)
    again = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in again)


def test_one_of_a_large_group_of_copies_comes_out(spark, tmp_path):
    """Copies that are a third of a source, and three of them among twelve: one document of each group stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").dropDuplicates(["text"]).orderBy("doc_id")
    texts = [r.text for r in docs.collect() if len(r.text) > 400 and r.text.count("\n") > 3][:34]
    rows = [(k, texts[0] if k < 12 else texts[k - 10], "large") for k in range(34)]
    rows += [(100 + k, texts[1] if k < 3 else texts[22 + k], "small") for k in range(12)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = P.drop_shared_lines(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in lines if r.doc_id < 12 or 100 <= r.doc_id < 103} == {i: t for i, t, _ in rows if i < 12 or 100 <= i < 103}
    near = [r.doc_id for r in P.drop_near_duplicates(spark, spark.createDataFrame(lines, docs.schema), str(tmp_path)).collect()]
    assert [i for i in near if i < 12] == [0] and [i for i in near if 100 <= i < 103] == [100]
    out = Counter(r.doc_id for r in P.run(spark, str(tmp_path)).collect())
    assert out[0] >= 1 and not any(out[i] for i in (*range(1, 12), 101, 102))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "source_mix", "bpe_codec"]
