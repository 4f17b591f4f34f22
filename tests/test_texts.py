from sparkloom.plans import registry


def test_documents_of_every_language_are_tokenised(spark, tmp_path):
    rows = [(1, "en", "The Cat, 2 dogs"), (2, "fr", "Le CHAT-noir"), (3, None, "x_Y"), (4, "de", "Haus 7!"), (5, "EN", ""), (6, "es", None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["tokens"] or [] for r in registry.core()[0]["text_tokenize"](spark, str(tmp_path)).collect()}
    assert got == {1: ["the", "cat", "2", "dogs"], 2: ["le", "chat", "noir"], 3: ["x", "y"], 4: ["haus", "7"], 5: [], 6: []}
