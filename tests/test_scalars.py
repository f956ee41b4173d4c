import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import scalars as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_hmac_is_the_standard_one(spark):
    for key in ("k", "x" * 100):
        want = hmac.new(key.encode(), b"42", hashlib.sha256).hexdigest()
        assert one(spark, S.hmac_sha256("u", key), u=42) == want
        assert one(spark, S.pseudonym("u", key), u=42) == want[:16]
    with pytest.raises(ValueError):
        S.pseudonym("u", "")


def test_text(spark):
    assert one(spark, S.capitalised("s"), s="curso DE dados") == "Curso de dados"
    assert one(spark, S.trimmed("s"), s=" \t a b\n") == "a b"
    assert one(spark, S.normalised("s"), s="  Introdução_à  Programação!! ") == "introducao a programacao"
    assert one(spark, S.normalised_author("s"), s="Prof. Dra. Ana Sá") == "ana sa"
    assert one(spark, S.normalised_author("s"), s="Drake Silva") == "drake silva"
    assert one(spark, S.embedding_text("a", "b"), a=" Um ", b="dois\n três") == "Um. dois três"
    assert one(spark, S.masked("s"), s="0123456789abcdef") == "usr_0123***cdef"


@pytest.mark.parametrize("minutes,band", [(29, "curta"), (30, "média"), (180, "média"), (181, "longa")])
def test_duration_band(spark, minutes, band):
    assert one(spark, S.duration_band("m"), m=minutes) == band


@pytest.mark.parametrize("later,earlier,months", [("2024-03-15", "2024-01-16", 1), ("2024-03-16", "2024-01-16", 2), ("2024-01-01", "2024-03-15", -2), ("2024-01-20", "2024-02-10", 0)])
def test_age_months(spark, later, earlier, months):
    assert one(spark, S.age_months(F.to_date("a"), F.to_date("b")), a=later, b=earlier) == months


def test_vectors(spark):
    assert one(spark, S.cosine_distance("a", "b"), a=[1.0, 0.0], b=[0.0, 2.0]) == pytest.approx(1.0)
    assert one(spark, S.cosine_distance("a", "b"), a=[0.0, 0.0], b=[0.0, 2.0]) is None
    assert one(spark, S.euclidean("a", "b"), a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx(2**0.5)
    assert one(spark, S.negative_dot("a", "b"), a=[1.0, 2.0], b=[3.0, 1.0]) == pytest.approx(-5.0)


def test_checks(spark):
    assert [one(spark, S.positive_id("s"), s=v) for v in ("7", "0", "-3", "7.9", "x", "")] == [True, False, False, False, False, False]
    assert [one(spark, S.iso_date("s"), s=v) for v in ("2026-01-05", "2026-1-1", "2026-02-30", "x")] == [True, True, False, False]
    assert [one(spark, S.iso_datetime("s"), s=v) for v in ("2026-01-05T10:00:00", "2026-01-05", "10:00", "x")] == [True, True, False, False]
    assert [one(spark, S.between_numbers("s", 1, 5), s=v) for v in ("1", "5.0", "5.1", "NaN", "x")] == [True, True, False, False, False]
    assert [one(spark, S.json_list("s"), s=v) for v in ("[]", '["a"]', '{"a":1}', "x")] == [True, True, False, False]
