"""A demonstration of the suite: python -m ledgerlight.evaluation. It ends with 1 where a case goes wrong or a test column is known by name."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerlight.evaluation import suite
from ledgerlight.plans.build import build

#: Orders by rule: three goods in each of eight orders, a customer each.
COLUMNS = "order_no string, sold_at timestamp_ntz, good string, units long, unit_price double, buyer string"
CASES = [
    suite.Case("units of each good", {"measures": ["units_sold"], "group_by": ["good"], "top_k": {"measure": "units_sold", "k": 3}}, "answer"),
    suite.Case("a measure that isn't there", {"measures": ["tax"]}, "refuse"), suite.Case("a column that isn't there", {"measures": ["units_sold"], "group_by": ["warehouse"]}, "refuse"),
    suite.Case("a concept that isn't there", {"unmet_concepts": ["profit"]}, "refuse"), suite.Case("a total of text", {"aggregations": [{"func": "sum", "column": "good"}]}, "refuse"),
]


def run(spark: SparkSession) -> tuple[suite.Report, list[str]]:
    rows = [(f"O{o}", f"2024-03-{10 + o % 3} 09:00", f"good {k}", 2 + (k + o) % 5, 1.5 + k + o % 3 / 4, f"buyer {o % 4}") for o in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, COLUMNS.replace("timestamp_ntz", "string")).selectExpr(*[f"cast({c} as {t}) {c}" for c, t in (x.rsplit(" ", 1) for x in COLUMNS.split(", "))])
    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    return suite.run(df, build(df, "demonstration"), CASES), suite.named_literals(str(Path(__file__).parent.parent / "plans"), names)


def main() -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    report, known = run(spark)
    for (expected, got), n in sorted(report.matrix.items()):
        print(f"{expected} -> {got}: {n}")
    print(f"false answers {report.false_answer_rate:.0%}", *report.wrong, *known, sep="\n")
    return int(bool(report.wrong or known or report.false_answer_rate))


if __name__ == "__main__":
    sys.exit(main())
