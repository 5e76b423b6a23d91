"""Fields of CSV lines."""

from fwlog.operators.csvlog import split_csv


def test_quoted_csv_fields_are_matched_once(spark):
    cases = {
        'a,b,"x ""y"" z"tail,more': 'x "y" ztail', 'a,b,"open ""q"" , end': 'open "q" , end', 'a,b," "" "': '"', 'a,b,""': "", 'a,b,"': "",
        'a,b,"x"y"z,w': 'xy"z', "a,b,plain,c": "plain", "a,b,": "", "a,b": None, 'a,b,"""": "': '": "', 'a,b,"x\ny"\n,c': "x\ny", "a,b,　p ": "p",
    }
    df = split_csv(spark.createDataFrame([(c,) for c in cases], "value string").repartition(2))
    assert sum(line.count("regexp_extract(__tail") for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n")) <= 2
    assert {r.value: r.csv_raw for r in df.collect()} == cases
