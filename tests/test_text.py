from pyspark.sql import functions as F

from contextloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("The parse_HTTP of é, a x Größe 42 4"))) == ["parse", "http", "é", "größe", "42"]


def test_symbol_tokens(spark):
    assert one(spark, X.symbol_tokens(F.lit("parseHTTPRequest_for_x"))) == ["parse", "http", "request", "for"]


def test_normalize(spark):
    assert one(spark, X.normalize(F.lit("User: ## Don't  stop, [now]!"))) == "dont stop now"
    assert one(spark, X.normalize(F.lit("User: hi"), keep_prefix=True)) == "user hi"


def test_whole_words(spark):
    assert one(spark, X.word_position(F.lit("we mustn must"), "must")) == 10
    assert one(spark, X.word_position(F.lit("must_not"), "must")) == 0
    assert one(spark, X.contains_word(F.lit("anything"), "")) is False


def test_cut_bytes(spark):
    assert one(spark, X.cut_bytes(F.lit("aéb"), 2)) == "a"
    assert one(spark, X.cut_bytes(F.lit("aéb"), 3)) == "aé"
    assert one(spark, X.cut_bytes(F.lit("aéb"), 9)) == "aéb"


def test_lines(spark):
    assert one(spark, X.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, X.lines(F.lit(""))) == []


def test_overlap(spark):
    a, b = X.overlap_tokens(F.lit("Use the (cache) layer")), X.overlap_tokens(F.lit("cache layer!"))
    assert one(spark, X.token_overlap(a, b)) == 1.0
    assert one(spark, X.token_overlap(X.overlap_tokens(F.lit("the")), X.overlap_tokens(F.lit("")))) == 0.0
