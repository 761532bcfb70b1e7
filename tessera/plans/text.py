"""One query for each string function, over part names, customer names and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import strings as S

#: name -> (expression, the same in DuckDB SQL), over part names.
CASES = {
    "str_len": (lambda s: S.str_len(s), "length(s)::INTEGER"),
    "upper": (lambda s: S.upper(s), "upper(s)"),
    "lower": (lambda s: S.lower(F.upper(s)), "lower(upper(s))"),
    "capitalize": (lambda s: S.capitalize(s), "upper(s[1]) || lower(s[2:])"),
    "swapcase": (lambda s: S.swapcase(S.capitalize(s)), "lower(s[1]) || upper(s[2:])"),
    "title": (lambda s: S.title(s), "list_aggregate([upper(w[1]) || lower(w[2:]) FOR w IN regexp_extract_all(s, '[a-zA-Z]+|[^a-zA-Z]+')], 'string_agg', '')"),
    "add": (lambda s: S.add(s, "!"), "s || '!'"),
    "multiply": (lambda s: S.multiply(s, 2), "repeat(s, 2)"),
    "strip": (lambda s: S.strip(S.add(F.lit("  "), S.add(s, " "))), "trim(s)"),
    "lstrip_chars": (lambda s: S.lstrip(s, "Part"), "ltrim(s, 'Part')"),
    "rstrip_chars": (lambda s: S.rstrip(s, "0123"), "rtrim(s, '0123')"),
    "ljust": (lambda s: S.ljust(s, 20, "."), "CASE WHEN length(s) >= 20 THEN s ELSE rpad(s, 20, '.') END"),
    "rjust": (lambda s: S.rjust(s, 20, "."), "CASE WHEN length(s) >= 20 THEN s ELSE lpad(s, 20, '.') END"),
    "center": (lambda s: S.center(s, 20, "."), "repeat('.', greatest(20 - length(s), 0)::BIGINT // 2) || s || repeat('.', greatest(20 - length(s), 0) - greatest(20 - length(s), 0) // 2)"),
    "zfill": (lambda s: S.zfill(F.concat(F.lit("-"), F.char_length(s).cast("string")), 8), "'-' || lpad(length(s)::VARCHAR, 7, '0')"),
    "find": (lambda s: S.find(s, "a"), "(instr(s, 'a') - 1)::INTEGER"),
    "rfind": (lambda s: S.rfind(s, "a"), "CASE WHEN instr(reverse(s), 'a') = 0 THEN -1 ELSE length(s) - instr(reverse(s), 'a') END::INTEGER"),
    "count": (lambda s: S.count(s, "a"), "(length(s) - length(replace(s, 'a', '')))::INTEGER"),
    "startswith": (lambda s: S.startswith(s, "P"), "starts_with(s, 'P')"),
    "endswith": (lambda s: S.endswith(s, "1"), "ends_with(s, '1')"),
    "replace": (lambda s: S.replace(s, "a", "<>"), "replace(s, 'a', '<>')"),
    "split": (lambda s: S.join("|", S.split(s)), "array_to_string([w FOR w IN regexp_split_to_array(s, '\\s+') IF w <> ''], '|')"),
    "split_sep": (lambda s: S.join("|", S.split(s, "a")), "array_to_string(string_split(s, 'a'), '|')"),
    "partition": (lambda s: S.join("|", S.partition(s, "a")), "CASE WHEN instr(s, 'a') = 0 THEN s || '||' ELSE substr(s, 1, instr(s, 'a') - 1) || '|a|' || substr(s, instr(s, 'a') + 1) END"),
    "rpartition": (lambda s: S.join("|", S.rpartition(s, "a")), "CASE WHEN instr(s, 'a') = 0 THEN '||' || s ELSE substr(s, 1, length(s) - instr(reverse(s), 'a')) || '|a|' || substr(s, length(s) - instr(reverse(s), 'a') + 2) END"),
    "translate": (lambda s: S.translate(s, "abc", "xyz"), "translate(s, 'abc', 'xyz')"),
    "slice": (lambda s: S.cut(s, 2, 6), "substr(s, 3, 4)"),
    "isalpha": (lambda s: S.isalpha(s), "regexp_full_match(s, '\\pL+')"),
    "isdigit": (lambda s: S.isdigit(F.regexp_replace(s, "[a-zA-Z ]", "")), "regexp_full_match(regexp_replace(s, '[a-zA-Z ]', '', 'g'), '[0-9]+')"),
    "isdecimal": (lambda s: S.isdecimal(F.regexp_replace(s, "[a-zA-Z ]", "")), "regexp_full_match(regexp_replace(s, '[a-zA-Z ]', '', 'g'), '[0-9]+')"),
    "isnumeric": (lambda s: S.isnumeric(F.regexp_replace(s, "[a-zA-Z ]", "")), "regexp_full_match(regexp_replace(s, '[a-zA-Z ]', '', 'g'), '[0-9]+')"),
    "isalnum": (lambda s: S.isalnum(s), "regexp_full_match(s, '[\\pL\\pN]+')"),
    "isspace": (lambda s: S.isspace(F.regexp_replace(s, "[a-zA-Z0-9]", "")), "regexp_full_match(regexp_replace(s, '[a-zA-Z0-9]', '', 'g'), '\\s+')"),
    "isupper": (lambda s: S.isupper(s), "regexp_matches(s, '\\p{Lu}') AND NOT regexp_matches(s, '\\p{Ll}')"),
    "islower": (lambda s: S.islower(s), "regexp_matches(s, '\\p{Ll}') AND NOT regexp_matches(s, '\\p{Lu}')"),
    "equal": (lambda s: s == S.lower(s), "s = lower(s)"),
    "less": (lambda s: s < F.lit("Part m"), "s < 'Part m'"),
    "not_equal": (lambda s: S.compare(s, S.lower(s), "!=", False), "s <> lower(s)"),
    "less_equal": (lambda s: S.compare(s, "Part m", "<=", False), "s <= 'Part m'"),
    "greater": (lambda s: S.compare(s, "Part m", ">", False), "s > 'Part m'"),
    "greater_equal": (lambda s: S.compare(s, "Part m", ">=", False), "s >= 'Part m'"),
    "compare_chararrays": (lambda s: S.compare(S.add(s, "  "), s, "=="), "rtrim(s || '  ') = rtrim(s)"),
    "rsplit": (lambda s: S.join("|", S.rsplit(s, "a")), "array_to_string(string_split(s, 'a'), '|')"),
    "rsplit_once": (lambda s: S.join("|", S.rsplit(s, "a", 1)), "CASE WHEN instr(s, 'a') = 0 THEN s ELSE substr(s, 1, length(s) - instr(reverse(s), 'a')) || '|' || substr(s, length(s) - instr(reverse(s), 'a') + 2) END"),
    "index": (lambda s: S.index(S.add(s, "a"), "a"), "(instr(s || 'a', 'a') - 1)::INTEGER"),
    "rindex": (lambda s: S.rindex(S.add(F.lit("a"), s), "a"), "(length(s) + 1 - instr(reverse('a' || s), 'a'))::INTEGER"),
    "mod": (lambda s: S.mod("%s has %d", s, F.char_length(s)), "s || ' has ' || length(s)"),
    "maketrans": (lambda s: S.translate(s, *S.maketrans("abc", "xyz", "rt")), "translate(replace(replace(s, 'r', ''), 't', ''), 'abc', 'xyz')"),
}


def _query(value):
    def run(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("s")).select("p_partkey", value(F.col("s")).alias("y"))

    return run


QUERIES = {f"strings_{name}": _query(value) for name, (value, _) in CASES.items()}
ORACLES = {f"strings_{name}": f"SELECT p_partkey, {sql} AS y FROM (SELECT p_partkey, p_name AS s FROM part)" for name, (_, sql) in CASES.items()}
