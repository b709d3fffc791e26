"""Schemas of the counter engine. Unsigned values are kept as BIGINT."""

from __future__ import annotations

#: One operation: pos tells the parts of a multi-delete apart; (lsn, pos) is unique.
OPS = "lsn bigint, pos int, op string, key string, bs bigint, t bigint"
RESULTS = f"{OPS}, result bigint"
#: One counter as of a log sequence number.
SNAPSHOT = "key string, batch_size bigint, value bigint, tx_at bigint, tx bigint"
#: One log record: a command and its textual arguments.
LOG = "lsn bigint, command_id int, arguments array<string>"

# Limits and codes that results depend on.
KEY_MAX_BYTES = 1024
BATCH_MIN, BATCH_MAX = 1, 4294967295
COMMANDS = {"UNKNOWN": 0, "INCR": 1, "GET": 2, "DEL": 3, "MSGSIZE": 4, "MDEL": 5, "WATCH": 6}
HASH_FACTOR, HASH_PARTITIONS = 31, 10
DUMP_PAGE, EXPIRY_GRACE = 1000, 60
MAX_MESSAGE = 4096
RETRY_BASE, RETRY_CAP = 1, 300
