"""All registered queries outside the subpackage for training data, and their SQL."""

from ledgerlight import files, loads, sales, streams

QUERIES: dict = {**sales.QUERIES, **loads.QUERIES, **streams.QUERIES, **files.QUERIES}
SQL: dict = {**sales.SQL, **loads.SQL, **streams.SQL, **files.SQL}
