import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from creditweir.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        4,
        app="creditweir-tests",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SOURCE = [
    "raw_row_id", "serious_dlqin_2yrs", "revolving_utilization_unsecured_lines", "age", "times_30_59_days_past_due",
    "debt_ratio", "monthly_income", "open_credit_lines_and_loans", "times_90_days_late", "real_estate_loans_or_lines",
    "times_60_89_days_past_due", "number_of_dependents",
]


def raw(bronze_id, applicant, **changes):
    row = dict(zip(SOURCE, [str(applicant), "0", "0.5", "40", "0", "0.3", "5000", "6", "0", "1", "0", "1"]))
    row.update(changes)
    return {"bronze_id": bronze_id, "ingestion_id": "run", **row}


@pytest.fixture
def bronze_rows():
    """Fifteen ordinary rows and one row for each quality rule."""
    rows = [raw(i, i) for i in range(15)]
    rows.append(raw(15, 15, monthly_income=""))
    rows.append(raw(16, 16, number_of_dependents=""))
    rows.append(raw(17, 17, age="0"))
    rows.append(raw(18, 18, revolving_utilization_unsecured_lines="50000"))
    rows.append(raw(19, 19, times_90_days_late="98"))
    return rows


@pytest.fixture
def make_bronze(spark):
    def make(rows):
        columns = ["bronze_id", "ingestion_id", *SOURCE]
        schema = "bronze_id bigint, " + ", ".join(f"{c} string" for c in columns[1:])
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)

    return make
