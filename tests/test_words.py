"""Words are the same as by the plain class, and ASCII is looked at first."""

from dossier.functions import exprs
from pyspark.sql import functions as F


def test_words_are_those_of_the_plain_class(spark):
    every = spark.range(0, 0x110000).where("id < 55296 or id > 57343").select(F.concat(F.lit("x"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), F.lit("y")).alias("c"))
    assert every.where(exprs.word_count(F.col("c")) != F.regexp_count("c", F.lit(f"[^{exprs.WHITE_SPACE}]+"))).isEmpty()
    assert exprs.WORD.startswith("[!-~")
