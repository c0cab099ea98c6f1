"""What is no text of a learned language is rejected, and the language's own texts stay."""

import base64
import random

from framewright.llm.common import fold
from framewright.llm.language import identify_languages, train_languages


def test_a_language_left_out_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.where("length(text) >= 200").cache()
    rng = random.Random(5)
    noise = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(40)]
    noise += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(40)]
    noisy = spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    taught = docs.where("lang <> 'es'")
    model = train_languages(taught.where(fold("doc_id", 4) != 2))
    share = lambda rows: identify_languages(rows, model).selectExpr("avg(cast(rejected as int))").first()[0]
    told = {"own": share(taught.where(fold("doc_id", 4) == 2)), "es": share(docs.where("lang = 'es'")), "noise": share(noisy)}
    print(told)
    assert told["own"] <= 0.01 and told["es"] >= 0.9 and told["noise"] >= 0.95, told


def test_sample_rows_reach_the_driver_without_their_zeros():
    """A dense row of counts takes 16 KB, whatever the text's length; the driver got all of the sample's."""
    from framewright.llm.language import BUCKETS, packed, term_counts, unpacked

    rows = term_counts(["a short text", "", "x" * 70_000])
    for row in rows:
        assert (unpacked(packed(row)) == row).all() and unpacked(packed(row)).dtype == row.dtype
        assert len(packed(row)) == 6 * (row > 0).sum() < 4 * BUCKETS / 10
