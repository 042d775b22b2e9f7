"""Registered queries and the SQL they are checked against."""

from plyforge.scale import spread

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


def documents(spark, folder, *columns):
    """The texts: long rows in few files, so they are dealt out to all cores."""
    return spread(table(spark, folder, "documents").select(*(columns or ("*",))))
