"""Ordered folds per key for recurrences no window function expresses.

Rows are hashed to partitions by key and sorted there by Spark (which can spill); Python sees
them as a stream of Arrow batches and holds the state of one key at a time, never its rows.
The same step function drives the streaming form.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are Python objects at once.
STEP = 16_384


def output_schema(df: DataFrame, added: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])


def run_batch(pdf: pd.DataFrame, inputs: list[str], states: Callable, step: Callable, names: list[str]):
    """Apply step to every row of a frame in order; states(key row) gives the mutable state."""
    out = [step(states(row), row) for row in pdf[inputs].to_dict("records")]
    return pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], added: str,
         new_state: Callable[[], object], step: Callable) -> DataFrame:
    """Append the columns ``step(state, row) -> tuple`` returns, in order within each key."""
    schema = output_schema(df, added)
    names = [f.name for f in T._parse_datatype_string(added).fields]
    wanted = list(dict.fromkeys([*keys, *inputs]))
    columns = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def states(row):
            nonlocal current, state
            key = tuple(row[k] for k in keys)
            if key != current:
                current, state = key, new_state()
            return state

        for pdf in batches:
            yield run_batch(pdf, wanted, states, step, names)[columns]

    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInPandas(run, schema)


def fold_stream(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], added: str,
                new_state: Callable[[], object], step: Callable) -> DataFrame:
    """Streaming form: state lives in the state store, rows of a micro-batch are put in order."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    schema = output_schema(df, added)
    names = [f.name for f in T._parse_datatype_string(added).fields]
    columns, wanted = schema.names, list(dict.fromkeys([*keys, *inputs]))
    arrow, df_names = to_arrow_schema(df.schema), df.columns

    class Folding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.saved = handle.getValueState("state", T.StructType([T.StructField("body", T.BinaryType())]))

        def handleInputRows(self, key, rows, timer_values):
            state = pickle.loads(self.saved.get()[0]) if self.saved.exists() else new_state()
            # The rows of a micro-batch are held as columns, repeated texts once; only a few at a time as Python objects.
            parts = []
            for pdf in rows:
                table = pa.Table.from_pandas(pdf, schema=arrow, preserve_index=False)
                parts.append(pa.table([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in table.columns], df_names))
            table = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
            parts.clear()
            place = pc.sort_indices(table.select(order), sort_keys=[(c, "ascending") for c in order])
            for at in range(0, len(place), STEP):
                pdf = table.take(place.slice(at, STEP)).cast(arrow).to_pandas()
                yield run_batch(pdf, wanted, lambda row: state, step, names)[columns]
            self.saved.update((pickle.dumps(state),))

        def close(self) -> None:
            pass

    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Folding(), outputStructType=schema, outputMode="Append", timeMode="None")
