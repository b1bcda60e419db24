"""Readers and sinks over small files."""

import json

from pyspark.sql import functions as F

from lexmill.sources import readers, sinks


def test_jsonl_keeps_malformed_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source_word": "aqua", "confidence": 0.9}\n\nnot json\n{"source_word": "manus"}\n', encoding="utf-8")
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r["source_word"] for r in good.collect()) == ["aqua", "manus"] and [r["value"] for r in bad.collect()] == ["not json"]
    limited, _ = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), limit=2)
    assert limited.count() == 1, "a limit counts physical lines"


def test_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"aqua": "water", "λόγος": {"gloss": "word"}, "x": ""}), encoding="utf-8")
    got = {r["form"]: (r["lang"], r["meaning"]) for r in readers.read_map(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"aqua": ("la", "water"), "λόγος": ("grc", "word")}
    (tmp_path / "n.json").write_text(json.dumps({"by_domain": {"sea": {"navis": "ship"}}, "global_safe": {"et": "and"}}), encoding="utf-8")
    assert sorted(map(tuple, readers.read_nested_map(spark, str(tmp_path / "n.json")).collect())) == [("global", "et", "and", 0.82), ("sea", "navis", "ship", 0.8)]


def test_pairs_first_and_last(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# comment\nAqua\twater\naqua\tliquid\nmanus\thand\n", encoding="utf-8")
    last = {r["form"]: r["gloss"] for r in readers.read_pairs(spark, str(tmp_path / "p.tsv")).collect()}
    first = {r["form"]: r["gloss"] for r in readers.read_pairs(spark, str(tmp_path / "p.tsv"), last_wins=False, cut=3).collect()}
    assert last == {"aqua": "liquid", "manus": "hand"} and first == {"aqua": "wat", "manus": "han"}


def test_csv_aliases(spark, tmp_path):
    (tmp_path / "c.csv").write_text("languageReference,Form\nla,aqua\nXXX,none\n", encoding="utf-8")
    got = readers.read_csv_aliased(spark, str(tmp_path / "c.csv"), {"lang": ["languageReference"], "form": ["value"]}, drop_value="XXX")
    assert [tuple(r) for r in got.collect()] == [("la", "aqua")]


def test_tags_senses_pools(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("U+13000\tkDesc\tman\nU+13000\tkCat\tA1\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_tags(spark, str(tmp_path / "t.tsv"), ["kDesc", "kCat"]).collect()] == [("U+13000", "man", "A1")]
    (tmp_path / "s.jsonl").write_text(json.dumps({"word": "aqua", "forms": [{"form": "aquae"}], "senses": [{"glosses": ["water", " water "]}, {"raw_glosses": ["sea"]}]}), encoding="utf-8")
    assert readers.read_senses(spark, str(tmp_path / "s.jsonl")).count() == 4
    (tmp_path / "n.json").write_text(json.dumps({"n_src": 1, "rows": [{"hyps": ["a", "b"], "scores": [0.1, 0.2]}]}), encoding="utf-8")
    assert [tuple(r) for r in readers.read_pools(spark, str(tmp_path / "n.json"), 1).collect()] == [(0, 0, "a", 0.1), (0, 1, "b", 0.2)]
    import pytest

    with pytest.raises(ValueError):
        readers.read_pools(spark, str(tmp_path / "n.json"), 2)


def test_parallel_names_concepts_packs(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\tla\taqua\n2\teng\twater\n3\tfra\teau\n", encoding="utf-8")
    (tmp_path / "l.tsv").write_text("1\t2\n", encoding="utf-8")
    s, links = readers.read_parallel(spark, str(tmp_path / "s.tsv"), str(tmp_path / "l.tsv"), ["la", "eng"])
    assert s.count() == 2 and [tuple(r) for r in links.collect()] == [(1, 2)]
    (tmp_path / "g.csv").write_text("place_id,title,language_tag,attested_form,romanized_form_1\n1,Roma,la,Roma,Roma\n2,Athenae,grc,Ἀθῆναι,Athenai\n", encoding="utf-8")
    assert readers.read_names(spark, str(tmp_path / "g.csv")).count() == 3
    (tmp_path / "c.csv").write_text("concept,language,form,v0\n1,la,aqua,0.1\n1,en,water,0.2\n2,la,manus,0.3\n", encoding="utf-8")
    assert {r["concept"]: r["en"] for r in readers.read_concepts(spark, str(tmp_path / "c.csv")).collect()} == {"1": "water", "2": "manus"}
    (tmp_path / "k.json").write_text(json.dumps({"lang": "el", "seeds": [{"form": "a", "gloss": "b", "lang": "el"}], "ethnonym_suffixes": ["x"]}), encoding="utf-8")
    packs = readers.read_packs(spark, str(tmp_path / "k.json")).collect()
    assert packs[0]["lang"] == "grc" and len(packs[0]["seeds"]) == 1


def test_boxes_checksums_numbers(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("gardiner\tconfidence\tsource\tbbox\nA1\t0.5\tnet\t1,2,3,4\n", encoding="utf-8")
    assert readers.read_hypotheses(spark, str(tmp_path / "h.tsv")).first()["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert len(readers.checksums(spark, str(tmp_path / "h.tsv")).first()["sha256"]) == 64
    numbered = readers.number_rows(spark.range(50).select((F.lit(49) - F.col("id")).alias("x")).repartition(5), "x")
    assert [r["ord"] for r in numbered.orderBy("x").collect()] == list(range(50))


def test_log_and_media(spark, tmp_path):
    sinks.append_log(spark.createDataFrame([(1, "a")], "id int, t string"), str(tmp_path / "log"))
    sinks.append_log(spark.createDataFrame([(2, "b")], "id int, t string"), str(tmp_path / "log"))
    assert sinks.replay_log(spark, str(tmp_path / "log"), "id int, t string").count() == 2
    assert sinks.png_bytes(2, 1, b"\0" * 6).startswith(b"\x89PNG") and len(sinks.wav_bytes(sinks.formants([440.0], 0.01))) == 44 + 320


def test_relational_scan_pushes_its_predicate(spark):
    """A database in memory, as the session's own Derby is one; its driver and this session's are one process."""
    url = "jdbc:derby:memory:lexmill;create=true"
    rows = spark.createDataFrame([(1, "aqua", "la"), (2, "hydor", "grc"), (3, "manus", "la")], "id int, word string, lang string")
    rows.write.format("jdbc").options(url=url, dbtable="words", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="word VARCHAR(40), lang VARCHAR(8)").mode("overwrite").save()
    df = readers.read_jdbc(spark, url, "words", "id >= 2 AND lang = 'la'", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert [r["word"] for r in df.collect()] == ["manus"]
    assert "GreaterThanOrEqual(ID,2)" in df._jdf.queryExecution().executedPlan().toString().replace("id", "ID")
