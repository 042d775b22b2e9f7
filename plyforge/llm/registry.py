"""Queries of this package and the SQL they are checked against."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
