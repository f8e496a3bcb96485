"""Protobuf values to JSON text, in Arrow batches inside the tasks."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from topicwise.operators.wire import wire_json

# Send the functions below to the executors themselves, which then need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of messages without a schema that are walked together.
WALKED_BYTES = 4 << 20


@dataclass(frozen=True)
class ProtoSpec:
    """A serialized ``FileDescriptorSet`` and a message name, short or full.

    Without a name the first message of the last file is used (compilers list imports first).
    """

    descriptor_set: bytes
    message: str | None = None


def message_json(spec: ProtoSpec | None):
    """A pandas function ``binary -> struct<json, error>``. NULL input gives NULL output."""

    @F.pandas_udf("json string, error string")
    def decode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        read = _with_schema(spec) if spec is not None else _without_schema
        for batch in batches:
            there = batch.notna().to_numpy()
            texts, errors = np.full(len(batch), None, object), np.full(len(batch), None, object)
            if there.any():
                texts[there], errors[there] = read(batch[there].tolist())
            yield pd.DataFrame({"json": texts, "error": errors}, index=batch.index)

    return decode_batches


def _without_schema(values: list[bytes]) -> tuple[list, list]:
    """Texts of messages, some megabytes of them at a time: a walk takes several times the bytes it reads."""
    place = np.cumsum([len(v) for v in values]) // WALKED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(values)]
    texts = [t for a, b in zip(cuts, cuts[1:]) for t in wire_json(values[a:b]).to_pylist()]
    return texts, [None] * len(values)


def _with_schema(spec: ProtoSpec):
    read_message = _schema_reader(spec)

    def read(values: list[bytes]) -> tuple[list, list]:
        texts, errors = [], []
        for value in values:
            text = error = None
            try:
                text = json.dumps(read_message(bytes(value)))
            except Exception as problem:  # noqa: BLE001 - the text is the result
                error = f"Protobuf schema decode error: {problem}"
            texts.append(text)
            errors.append(error)
        return texts, errors

    return read


def _schema_reader(spec: ProtoSpec):
    from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory

    files = descriptor_pb2.FileDescriptorSet.FromString(spec.descriptor_set).file
    pool = descriptor_pool.DescriptorPool()
    names = {}
    for file in files:
        pool.Add(file)
        for message in file.message_type:
            full = f"{file.package}.{message.name}" if file.package else message.name
            names[message.name] = names[full] = full
    first = files[-1].message_type[0].name
    full_name = names.get(spec.message or first, names[first])
    cls = message_factory.GetMessageClass(pool.FindMessageTypeByName(full_name))

    def read(value: bytes) -> dict:
        return json_format.MessageToDict(
            cls.FromString(value), preserving_proto_field_name=True, always_print_fields_with_no_presence=True
        )

    return read
