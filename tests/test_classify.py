import pytest
from pyspark.sql import functions as F

from cleanloom.functions import classify as C
from conftest import values

COLUMNS = ["id", "total_price", "price", "city"]


def ask(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return values(df.withColumn("out", expr(F.col("t"))), "out", "i")


def test_goal_tasks(spark):
    goals = {
        "Predict customer churn with XGBoost": "classification", "Forecast monthly revenue per city": "regression", "Cluster customers into segments": "clustering",
        "I want to build a classification model": "unknown", "sentiment analysis of reviews": "nlp", "ARIMA on daily load": "timeseries", "build a dashboard for BI": "eda",
    }
    assert ask(spark, list(goals), C.goal_task) == list(goals.values())


def test_goal_target_prefers_the_spoken_and_the_longest(spark):
    got = ask(spark, ["predict the Total Price", "group by city, price matters", "estimate churn", "city", "predict ..  "], lambda t: C.goal_target(t, COLUMNS))
    assert got == ["total_price", "price", None, "city", "total_price"]


def test_keywords_and_summary(spark):
    assert ask(spark, ["Price price of the best HOUSE"], C.goal_keywords) == [["price", "best", "house"]]
    df = spark.createDataFrame([("nlp", None), ("unknown", "y")], "task string, target string")
    assert values(df.select(C.goal_summary(F.col("task"), F.col("target")).alias("s")), "s") == [
        "Aligning to a NLP / text model.", 'Objective noted — target column "y". I\'ll keep suggestions general-purpose.']


@pytest.mark.parametrize("message,intent", [
    ("hello", "greeting"), ("history", "fallback"), ("Auto clean please", "auto_clean"), ("what is wrong", "priorities"), ("check city", "column_analysis"),
    ("finance", "nulls"), ("dedupe", "duplicates"), ("winsorize", "outliers"), ("knn", "knn"), ("a string", "types"), ("showcase", "text_hygiene"), ("download", "export"),
    ("undo", "undo"), ("start over", "reset"), ("undoing", "undo_help"), ("capabilities", "help"), ("the city", "column_mention"), ("thanks", "fallback"),
    ("élégant knné", "knn"),
])
def test_intents(spark, message, intent):
    assert ask(spark, [message], lambda t: C.message_intent(t, COLUMNS)) == [intent]


def test_intent_without_a_table(spark):
    assert ask(spark, ["this", "bye"], lambda t: C.message_intent(t, None)) == ["no_data_help", "no_data"]
