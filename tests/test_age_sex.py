import pytest
from pyspark.sql import functions as F

from trialloom.functions import lexicon


@pytest.mark.parametrize(
    ("text", "want"),
    [("患者，女，63岁", (63, "female")), ("45 岁男性, 50 years old", (45, "male")), ("a 50-year-old man, 45岁", (50, "male")), ("200岁", (None, None)), ("岁", (None, None)), (None, (None, None))],
)
def test_ages_in_chinese_and_english(spark, text, want):
    age, sex = lexicon.age_sex(F.lit(text).cast("string"))
    assert tuple(spark.range(1).select(age, sex).first()) == want
