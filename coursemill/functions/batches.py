"""Python over texts in small parts of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of texts that a task holds as Python strings, about; a text of its own may be longer.
PART_BYTES = 1 << 20


def by_parts(texts: Column, use: Callable[[str | None], Any], kind: DataType) -> Column:
    """What `use` makes of each text. A batch is cut into parts of a few texts, and a part is returned before the next one is
    read, so that a task holds strings of one part and not of all rows of a batch."""
    of = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            start, n = 0, max(1, len(batch) * PART_BYTES // max(1, batch.nbytes))
            while start < len(batch):
                part = batch.slice(start, n)
                yield pa.array([use(x) for x in part.to_pylist()], of)
                start += n
            if not len(batch):
                yield pa.array([], of)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(texts)
