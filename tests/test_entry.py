"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and all(n in sql for n in known if n.startswith("q_"))
