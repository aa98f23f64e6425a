"""What Python workers hold at once has a bound that does not grow with a task's rows."""

from types import SimpleNamespace

import pyarrow as pa

from quillmark.operators import transfer
from quillmark.sources.io import table


class Kernel:
    """Stands for texts and gives the kernel that they would be mapped by."""

    schema = SimpleNamespace(fields=[SimpleNamespace(name=c, dataType=SimpleNamespace(simpleString=lambda: "string")) for c in transfer.KEYS])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, kinds):
        return run


def test_views_come_in_batches_of_few_passages():
    n = 4 * transfer.VIEWED + 3
    versions = [[{"domain": "original", "text": "a b c " * 80}, {"domain": "half", "text": "a b c " * 70}]] * n
    batch = pa.RecordBatch.from_arrays([*(pa.array([f"{c}{i}" for i in range(n)]) for c in transfer.KEYS), pa.array(versions)], [*transfer.KEYS, "versions"])
    made = list(transfer.panel_views(Kernel())(iter([batch])))
    assert sum(b.num_rows for b in made) == n * 2 * 5
    assert max(b.num_rows for b in made) <= transfer.VIEWED * 2 * len(transfer.PANELS)


def test_given_tables_are_read_in_small_batches(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    table(spark, sf_dir, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
