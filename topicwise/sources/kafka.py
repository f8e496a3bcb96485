"""Connection settings and option dictionaries of Spark's Kafka source and sink."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KafkaConfig:
    """Broker, security and time-out settings. Spark never commits offsets, so there is no auto-commit to turn off."""

    bootstrap_servers: str = "localhost:9092"
    client_id: str = "topicwise"
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str | None = None
    sasl_username: str | None = None
    sasl_password: str | None = None
    ssl_cafile: str | None = None
    ssl_certfile: str | None = None
    ssl_keyfile: str | None = None
    request_timeout_ms: int = 15_000

    @classmethod
    def from_file(cls, path: str) -> KafkaConfig:
        """Read a JSON file of settings. Keys other than the fields above are ignored."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    def options(self, producer: bool = False) -> dict[str, str]:
        found = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "kafka.client.id": f"{self.client_id}-producer" if producer else self.client_id,
            "kafka.security.protocol": self.security_protocol,
            "kafka.request.timeout.ms": str(self.request_timeout_ms),
        }
        if self.sasl_mechanism:
            found["kafka.sasl.mechanism"] = self.sasl_mechanism
        if self.sasl_username and self.sasl_password:
            found["kafka.sasl.jaas.config"] = self._login()
        if self.ssl_cafile:
            found |= {"kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.location": self.ssl_cafile}
        if self.ssl_certfile and self.ssl_keyfile:
            # A key file of its own goes inline, with its certificates; Kafka wants it as PKCS #8.
            found |= {
                "kafka.ssl.keystore.type": "PEM",
                "kafka.ssl.keystore.certificate.chain": Path(self.ssl_certfile).read_text(encoding="ascii"),
                "kafka.ssl.keystore.key": Path(self.ssl_keyfile).read_text(encoding="ascii"),
            }
        elif self.ssl_certfile:
            found |= {"kafka.ssl.keystore.type": "PEM", "kafka.ssl.keystore.location": self.ssl_certfile}
        return found

    def _login(self) -> str:
        kind = "scram.ScramLoginModule" if (self.sasl_mechanism or "").startswith("SCRAM") else "plain.PlainLoginModule"
        user, password = (v.replace("\\", "\\\\").replace('"', '\\"') for v in (self.sasl_username, self.sasl_password))
        return f'org.apache.kafka.common.security.{kind} required username="{user}" password="{password}";'


def read_options(
    topics: str | Iterable[str],
    config: KafkaConfig | None = None,
    from_beginning: bool = False,
    partition: int | None = None,
    tail_offsets: Mapping[str, Mapping[int, int]] | None = None,
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Source options for one topic, several (``"a,b"`` or a list), or one partition of each.

    ``tail_offsets`` (from :func:`tail_start_offsets`) starts each partition at a given offset; ``from_beginning`` starts at the
    earliest; otherwise a stream starts at the latest.
    """
    names = [t.strip() for t in (topics.split(",") if isinstance(topics, str) else topics) if t.strip()]
    found = (config or KafkaConfig()).options() | {"includeHeaders": "true"}
    if partition is None:
        found["subscribe"] = ",".join(names)
    else:
        found["assign"] = json.dumps({t: [partition] for t in names})
    if tail_offsets is not None:
        starts = {t: {str(p): o for p, o in parts.items()} for t, parts in tail_offsets.items()}
        found["startingOffsets"] = json.dumps(starts)
    else:
        found["startingOffsets"] = "earliest" if from_beginning else "latest"
    if max_per_trigger is not None:
        found["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return found


def tail_start_offsets(watermarks: Iterable[Mapping], n: int) -> dict[str, dict[int, int]]:
    """Start of the last ``n`` offsets of each partition, never before its beginning.

    ``watermarks`` are rows with ``topic, partition, beginning_offset, log_end_offset``, one per partition of the topic.
    """
    starts: dict[str, dict[int, int]] = {}
    for row in watermarks:
        start = max(row["beginning_offset"], row["log_end_offset"] - n)
        starts.setdefault(row["topic"], {})[row["partition"]] = start
    return starts


Ranges = dict[str, dict[int, tuple[int, int]]]


def planned_ranges(watermarks: Iterable[Mapping], first: int | None = None, last: int | None = None, tail: int | None = None) -> Ranges:
    """(start, end) offsets to read of each partition, ``end`` exclusive: offsets ``first`` to ``last``, or the last ``tail``.

    ``watermarks`` are rows as for :func:`tail_start_offsets`. What they do not hold is left out, and with it a partition
    that has nothing to read, so a single record is ``first = last`` on the row of its partition.
    """
    found: Ranges = {}
    for row in watermarks:
        start, end = row["beginning_offset"], row["log_end_offset"]
        if tail is not None:
            start = max(start, end - tail)
        start = start if first is None else max(start, first)
        end = end if last is None else min(end, last + 1)
        if start < end:
            found.setdefault(row["topic"], {})[row["partition"]] = (start, end)
    return found


def range_options(ranges: Ranges, config: KafkaConfig | None = None) -> dict[str, str]:
    """Options of a batch that reads just ``ranges``; offsets that are gone meanwhile do not fail it."""
    if not ranges:
        raise ValueError("no partition has anything to read")
    side = lambda i: json.dumps({t: {str(p): r[i] for p, r in parts.items()} for t, parts in ranges.items()})
    return (config or KafkaConfig()).options() | {
        "includeHeaders": "true",
        "assign": json.dumps({t: sorted(parts) for t, parts in ranges.items()}),
        "startingOffsets": side(0),
        "endingOffsets": side(1),
        "failOnDataLoss": "false",
    }


def read_ranges(spark: SparkSession, ranges: Ranges, config: KafkaConfig | None = None) -> DataFrame:
    """RAW records of the ranges only: brokers are asked for nothing else."""
    return spark.read.format("kafka").options(**range_options(ranges, config)).load()


def in_ranges(log: DataFrame, ranges: Ranges) -> DataFrame:
    """The same choice on a stored log; the filter reaches the file scan."""
    parts = [(t, p, r) for t, found in sorted(ranges.items()) for p, r in sorted(found.items())]
    wanted = F.lit(False)
    for topic, partition, (start, end) in parts:
        wanted |= (F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < end)
    return log.filter(wanted)


def read_stream(spark: SparkSession, topics: str | Iterable[str], **how) -> DataFrame:
    """Live RAW records of the topics; see :func:`read_options`."""
    return spark.readStream.format("kafka").options(**read_options(topics, **how)).load()


def read_batch(spark: SparkSession, topics: str | Iterable[str], **how) -> DataFrame:
    """RAW records from the given start up to the present end. A batch cannot start at the latest offset."""
    given = {"from_beginning": True} | how
    return spark.read.format("kafka").options(**read_options(topics, **given)).option("endingOffsets", "latest").load()


def from_topics(log: DataFrame, topics: str | Iterable[str], partition: int | None = None) -> DataFrame:
    """The same choice on a stored log; the filter reaches the file scan."""
    names = [t.strip() for t in (topics.split(",") if isinstance(topics, str) else topics) if t.strip()]
    kept = log.filter(F.col("topic").isin(*names))
    return kept if partition is None else kept.filter(F.col("partition") == partition)


def lookup(log: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Records at ``coordinates(topic, partition, offset)``."""
    on = ["topic", "partition", "offset"]
    return log.join(coordinates.select(*on).distinct(), on, "left_semi")


def record_at(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """One record; the filter reaches the file scan and prunes row groups by offset."""
    return log.filter((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))
