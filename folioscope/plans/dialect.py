"""The few places where Spark's SQL and the oracle's differ."""

from __future__ import annotations


class Spark:
    word = r"r'[\p{L}\p{N}]+'"

    @staticmethod
    def agg(x, order, sep=","):
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    @staticmethod
    def like(x, pattern):
        return f"regexp_like({x}, r'{pattern}')"

    @staticmethod
    def extract(x, pattern, group=0):
        return f"regexp_extract({x}, r'{pattern}', {group})"

    @staticmethod
    def replace(x, pattern, to):
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    @staticmethod
    def words(x):
        return f"regexp_extract_all({x}, r'[\\p{{L}}\\p{{N}}]+', 0)"

    @staticmethod
    def explode(array, frm, i="i", w="w"):
        """frm with a row for each element: index from 0 and value."""
        return f"{frm} LATERAL VIEW posexplode({array}) AS {i}, {w}"

    @staticmethod
    def join(array, sep=" "):
        return f"array_join({array}, '{sep}')"

    @staticmethod
    def seconds(ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000.0D"

    @staticmethod
    def micros(ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    @staticmethod
    def day(ts):
        return f"CAST(CAST({ts} AS DATE) AS STRING)"

    @staticmethod
    def hour(ts):
        return f"CAST(hour({ts}) AS BIGINT)"

    @staticmethod
    def json(x, key):
        return f"get_json_object({x}, '$.{key}')"

    @staticmethod
    def plus_days(ts, n):
        return f"({ts} + INTERVAL {n} DAY)"

    @staticmethod
    def sha256(x):
        return f"sha2({x}, 256)"

    @staticmethod
    def size(array):
        return f"CAST(size({array}) AS BIGINT)"

    @staticmethod
    def slice(array, a, n):
        return f"slice({array}, {a}, {n})"

    text = "STRING"
    median = staticmethod(lambda x: f"percentile({x}, 0.5)")
    lam = staticmethod(lambda v, body: f"{v} -> {body}")
    filter = staticmethod(lambda a, v, body: f"filter({a}, {v} -> {body})")
    any_of = staticmethod(lambda a, v, body: f"exists({a}, {v} -> {body})")
    intersect = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    instr = staticmethod(lambda x, y: f"instr({x}, {y})")


class Duck(Spark):
    @staticmethod
    def agg(x, order, sep=","):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    @staticmethod
    def like(x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def extract(x, pattern, group=0):
        return f"regexp_extract({x}, '{pattern}', {group})"

    @staticmethod
    def replace(x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def words(x):
        return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"

    @staticmethod
    def explode(array, frm, i="i", w="w"):
        return f"(SELECT *, unnest(range(len({array}))) AS {i}, unnest({array}) AS {w} FROM {frm})"

    @staticmethod
    def join(array, sep=" "):
        return f"array_to_string({array}, '{sep}')"

    @staticmethod
    def seconds(ts):
        return f"epoch_us({ts}) / 1000000.0"

    @staticmethod
    def micros(ts):
        return f"epoch_us({ts})"

    @staticmethod
    def day(ts):
        return f"CAST(CAST({ts} AS DATE) AS VARCHAR)"

    @staticmethod
    def hour(ts):
        return f"CAST(hour({ts}) AS BIGINT)"

    @staticmethod
    def json(x, key):
        return f"json_extract_string({x}, '$.{key}')"

    @staticmethod
    def sha256(x):
        return f"sha256({x})"

    @staticmethod
    def size(array):
        return f"CAST(len({array}) AS BIGINT)"

    @staticmethod
    def slice(array, a, n):
        return f"list_slice({array}, {a}, {a} + {n} - 1)"

    text = "VARCHAR"
    median = staticmethod(lambda x: f"quantile_cont({x}, 0.5)")
    filter = staticmethod(lambda a, v, body: f"list_filter({a}, lambda {v}: {body})")
    any_of = staticmethod(lambda a, v, body: f"len(list_filter({a}, lambda {v}: {body})) > 0")
    intersect = staticmethod(lambda a, b: f"list_intersect({a}, {b})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    instr = staticmethod(lambda x, y: f"instr({x}, {y})")
