import re

from pyspark.sql import functions as F

from pageloom.functions import text

A = F.col("a")
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def test_white_space_is_what_python_strips(column):
    assert sorted(text.WHITESPACE) == sorted(SPACES)
    padded = [SPACES + "x y" + SPACES, SPACES, "", "\x00a\x00"]
    assert column(text.strip(A), *padded) == [p.strip() for p in padded]


def test_token_counts(column):
    texts = ["", "abc", "abcd", "ä" * 9, "a b\n\nc", "x y\x1fz", None]
    assert column(text.count_tokens(A), *texts) == [len(t or "") // 4 for t in texts]
    assert column(text.count_tokens(A, "words"), *texts) == [len(re.findall(r"\S+|\n", t or "")) for t in texts]


def test_truncation_counts_whole_tokens(column):
    assert column(text.truncate_tokens(A, 2), "a" * 8, "a" * 11, "a" * 12) == ["a" * 8, "a" * 11, "a" * 8]


def test_squeeze(column):
    texts = [
        "a\n\n\n\nb   \nc", "x \t y\n   * z", "  \n\n lead", "a" + " " * 50 + "\n" * 5 + "\t\tb", "\xa0a\xa0", "a \n \n b",
    ]

    def plain(t):
        for pattern, to in ((r"\n{3,}", "\n\n"), (r" +\n", "\n"), (r"[ \t]{2,}", " "), (r"\n +\*", "\n*")):
            t = re.sub(pattern, to, t)
        return t.strip()

    assert column(text.squeeze_whitespace(A), *texts) == [plain(t) for t in texts]


def test_lenient_decoding(spark):
    raw = [b"ok", b"\xff\xfea", "�é".encode(), b"a\xc3", b"\xe2\x82b", "𝄞".encode()[:3] + b"z"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, raw binary")
    got = [r[0] for r in df.orderBy("i").select(text.decode_utf8_lenient(F.col("raw"))).collect()]
    assert got == [r.decode("utf-8", "ignore") for r in raw]
