"""Languages with fewer teaching documents than `min_docs`."""

from pyspark.sql import functions as F

from vigilake.llm import language


def test_a_language_of_one_or_two_documents_is_learned(spark):
    rows = [(i, f"the weather is nice today and we should think about those things {i}", "en") for i in range(30)]
    rows += [(40, "das wetter ist heute schön", "de"), (50, "quel temps magnifique", "fr"), (51, "bonjour madame", "fr")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    known = language.fit(docs, "id", "text", "lang", allowed=F.lit(True), n_slots=1 << 12)
    assert [known.decide(t)[0] for t in ("wetter heute", "magnifique madame", "nice weather")] == ["de", "fr", "en"]
