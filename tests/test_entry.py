"""Driver contract: entry runs, registry and oracle keys line up, no capped queries."""

import os

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"qid", "sim_rank", "event_id", "similarity_score"}


def test_oracle_keys_subset_of_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_nothing_caps_or_samples_rows():
    """Neither the registered queries nor the helpers they call."""
    import sigsight

    root = os.path.dirname(sigsight.__file__)
    for folder in ("functions", "operators", "plans", "sources", "streaming"):
        for name in os.listdir(os.path.join(root, folder)):
            if name.endswith(".py"):
                with open(os.path.join(root, folder, name)) as f:
                    code = f.read()
                assert ".limit(" not in code and ".sample(" not in code, name
