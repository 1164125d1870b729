import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoprank.functions import tune  # noqa: E402
from shoprank.operators.folds import fold_inputs  # noqa: E402

TX = "customer_id string, article_id string, t_dat date, price double, sales_channel_id int"
PEOPLE = ("customer_id string, age double, postal_code string, club_member_status string, "
          "fashion_news_frequency string")
ARTICLES = ("article_id string, product_code bigint, product_type_no bigint, department_no bigint, "
            "product_group_name string, garment_group_no bigint, section_no bigint, index_group_no bigint, "
            "colour_group_code bigint")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def make_fold(spark):
    """A fold from short rows (user, item, 'MM-DD'[, price[, channel]]) of the year 2020."""
    def build(train, people=(), articles=(), log=None, val=None):
        def frame(rows):
            full = [(r[0], r[1], date.fromisoformat(f"2020-{r[2]}"), *(r[3:] or ()),) for r in rows]
            return spark.createDataFrame([(*r, *(10.0, 1)[len(r) - 3:]) for r in full], TX)

        people_df = spark.createDataFrame([(*p, *(None,) * (5 - len(p))) for p in people], PEOPLE)
        articles_df = spark.createDataFrame([(*a, *(0, 0, "g", 0, 0, 0, 0)[len(a) - 2:]) for a in articles], ARTICLES)
        train_df = frame(train)
        return fold_inputs("fold_0", train_df, None if val is None else frame(val),
                           train_df if log is None else frame(log), articles_df, people_df)

    return build


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())
