"""Small tables for the tests of the text operators."""


def table(spark, folder, rows, schema, parts=3):
    """A stored table of ``rows``, read back."""
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def smallest_reachable(nodes, edges):
    """node -> smallest node reachable over ``edges``, itself included."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(out[a], out[b])
            for n in (a, b):
                if out[n] != low:
                    out[n] = low
                    changed = True
    return out
