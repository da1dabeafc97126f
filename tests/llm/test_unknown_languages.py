"""Language ID of the pipeline keeps only texts in learned languages."""

import os
import random
import string

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOREIGN = {
    "tr": "Bugün hava çok güzel ve çocuklar parkta oynuyor. Annem mutfakta yemek yapıyor, babam ise gazete okuyor. Akşam olunca hep birlikte sofraya oturup günümüzü anlatırız.",
    "fi": "Tänään on kaunis päivä ja lapset leikkivät puistossa. Äitini valmistaa ruokaa keittiössä ja isä lukee sanomalehteä. Illalla istumme kaikki yhdessä pöydän ääressä.",
    "pl": "Dzisiaj jest piękna pogoda i dzieci bawią się w parku. Mama gotuje obiad w kuchni, a tata czyta gazetę. Wieczorem wszyscy razem siadamy do stołu.",
    "ru": "Сегодня хорошая погода, и дети играют в парке. Мама готовит обед на кухне, а отец читает газету.",
}


def letters(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(3, 9))) for _ in range(words))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_id_rejects_other_languages_and_random_letters(spark):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [*FOREIGN.values(), *(letters(n, n) for n in (10, 50, 300, 3000))]
    # ids that are not among the learning rows
    ids = [r["id"] for r in spark.range(10**6, 10**6 + 100).filter("crc32(CAST(id AS STRING)) % 4 = 2").collect()]
    docs = rows.unionByName(spark.createDataFrame([(i, t, None, "junk", len(t)) for i, t in zip(ids, junk)], DOCS).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
    kept = dict(p.STAGES)["language_id"](spark, docs, SF)
    assert kept.filter("source = 'junk'").count() == 0
    lettered = rows.filter(F.col("text").rlike(r"\p{L}"))
    assert kept.count() >= 0.99 * lettered.count()
