"""Expressions against plain Python: hand-made edges and random strings."""

import os
import random
import uuid

from pyspark.sql import functions as F

from dossier.functions import exprs, text
from dossier.operators.extract import decode_text

NAMES = ["a.pdf", ".pdf", "..pdf", "a..pdf", "d.x/file", "d.x/.txt", "A.DOCX", "foo.", "x.tar.Txt", "", "noext", "a.txt\n", "a/.b/c.d"]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extension(spark):
    draw = random.Random(1)
    names = NAMES + ["".join(draw.choice("aB./ \n") for _ in range(draw.randint(0, 9))) for _ in range(2000)]
    assert column(spark, names, exprs.file_extension) == [os.path.splitext(n.lower())[1] for n in names]


def test_word_count(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    draw = random.Random(2)
    texts = ["", " ", "a​b", *(f"x{c}y" for c in spaces)] + ["".join(draw.choice(["a", "é", *spaces]) for _ in range(20)) for _ in range(500)]
    assert column(spark, texts, exprs.word_count) == [len(t.split()) for t in texts]


def test_uuid(spark):
    plain = str(uuid.UUID(int=0x1234567890ABCDEF1234567890ABCDEF))
    values = [plain, plain.upper(), "{" + plain + "}", "urn:uuid:" + plain, plain.replace("-", ""), "abc", "", None, plain + "0", plain + "\n"]
    values += ["0x" + "a" * 30, "0X_" + "B" * 29, "1_" * 15 + "12", "+" + "a" * 31, "+0x" + "a" * 29, " " + "a" * 31, "a" * 31 + " ", "a" * 30 + "\n\t", "\u3000" + "a" * 31, "\u0663" * 32, "__" + "a" * 30, "a" * 31 + "_", "+ " + "a" * 30, "\x1c" + "a" * 31, "0_x" + "a" * 29, "-" * 4 + "a" * 32, "{urn:uuid:" + plain + "}}", "g" * 32]

    def parsed(v):
        try:
            return str(uuid.UUID(v))
        except (ValueError, AttributeError, TypeError):
            return None

    assert column(spark, values, exprs.parse_uuid) == [parsed(v) for v in values]


def test_decode(spark):
    values = [bytes.fromhex("6162fffe63e282"), "é﻿".encode(), b"\xef\xbb\xbfx", b"", None, b"\xf0\x9f\x8e\x88\xf0\x9f"]
    assert column(spark, values, decode_text, "binary") == [None if v is None else v.decode("utf-8", "ignore") for v in values]


def test_upload_rules(spark):
    rows = [("x.md", "text/plain", True), ("x.text", None, False), ("x.text", "text/plain", True), ("x.txt", "image/png", True), ("x", None, False), (None, None, False)]
    df = spark.createDataFrame(rows, "name string, mime string, want boolean")
    for r in df.select("*", exprs.upload_allowed(F.col("name"), F.col("mime")).alias("got"), exprs.reject_reason(F.col("name"), F.col("mime")).alias("why")).collect():
        assert r.got == r.want and (r.why is None) == r.want
    assert column(spark, ["x.md", "a.text", "b.PDF"], exprs.file_kind) == [None, "txt", "pdf"]
    assert column(spark, ["x.md"], exprs.kind_error) == ["Unsupported file extension: .md"]


def test_status_preview_tenant(spark):
    long = "ab🎈" * 100
    rows = [("completed", long[:299], long[:299]), ("COMPLETED", long + "x", long[:300]), ("COMPLETED", "", None), ("FAILED", "t", None), (None, "t", None), ("", "t", None)]
    df = spark.createDataFrame(rows, "status string, t string, want string")
    assert all(r.want == r.got for r in df.select("want", exprs.text_preview(F.col("status"), F.col("t")).alias("got")).collect())
    assert column(spark, ["", None, "failed"], exprs.status_view) == ["PENDING", "PENDING", "FAILED"]
    assert column(spark, ["test-org", "tenant-abc-123", None, ""], exprs.tenant_captured) == [True, True, False, False]
    assert column(spark, ["", "T", None], lambda c: exprs.display_name(c, F.lit("f"))) == ["f", "T", "f"]


def test_obligations_and_codes(spark):
    docs = spark.createDataFrame([(1, "You must act. Fine!\nWe shall not wait? Ok."), (2, "Art. 32 Security\nCC1.1: Control\nplain"), (3, None)], "id int, extracted_text string")
    assert [(r.seq, r.term) for r in text.extract_obligations(docs).orderBy("seq").collect()] == [(0, "must"), (2, "shall not")]
    assert [(r.code, r.title) for r in text.extract_requirement_codes(docs).orderBy("seq").collect()] == [("Art. 32", "Security"), ("CC1.1", "Control")]
