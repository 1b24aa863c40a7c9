"""Configuration: sheets -> config tables.

A sheet is any all-string DataFrame (see ``sources.sheets``). Shaping is a
projection; the rule parameters of each validation are folded into one JSON
string by a native Column expression (no Python UDF). A sync replaces each
config table by its sheet, reporting INSERT / UPDATE / DELETE / UNCHANGED
per key from one full outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions.lists import comma_list, split_tags
from tessera.operators.dataset_rules import AGGREGATES
from tessera.operators.upsert import conform, reflect
from tessera.schemas import RULES_SCHEMA, TABLES_SCHEMA, VALIDATIONS_SCHEMA
from tessera.sources.sheets import as_sheet, require_columns

# Sheet headers of the original spreadsheet template, mapped
# to the English header names used here. Sheets may use either.
TABLES_HEADERS = {
    "Id_tabla": "table_id",
    "Nombre_tabla": "table_name",
    "Nombre_técnico": "table_name_tech",
    "Dominio": "domain",
    "Clave_primaria": "primary_key",
    "Tabla_staging_evidencias": "staging_evidences_table",
}
RULES_HEADERS = {
    "Id_regla": "rule_id",
    "Nombre_técnico": "technical_rule_name",
    "Nombre_funcional": "functional_name",
    "Descripción": "description",
    "Nivel_regla": "rule_level",
    "Dimensión_reglas": "dimension_dq",
    "Tipo_implementación": "implementation_type",
    "Requiere_conversión_literal": "requires_literal_conversion",
    "Etiquetas": "tags",
    "Clase": "type_rule",
    "Propietario": "owner",
    "Actualizado_por": "updated_by",
}
VALIDATIONS_HEADERS = {
    "Id_validación": "validation_id",
    "Id_regla": "rule_id",
    "Id_tabla": "table_id",
    "Definición_perimetro": "perimeter_definition",
    "Validación_activa": "is_active",
    "Severidad": "severity",
    "Nombre_técnico": "technical_name",
    "Tipo_regla": "rule_type",
    "Param_columnas": "param_columns",
    "Param_valor": "param_value",
    "Param_valor_min": "param_min",
    "Param_valor_max": "param_max",
    "Param_conjunto": "param_set",
    "Param_expresion": "param_expression",
    "Param_tipo_dato": "param_data_type",
    "Param_query_SQL": "param_query",
    "Param_merge_columnas": "param_merge_columns",
    "Owner": "owner",
    "Etiquetas": "tags",
    "Actualizado_por": "updated_by",
    "Dominio_tabla": "table_domain",
}


def _rename(sheet: DataFrame, headers: dict[str, str]) -> DataFrame:
    sheet = as_sheet(sheet)
    return sheet.select(*[F.col(f"`{c}`").alias(headers.get(c, c)) for c in sheet.columns])


def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_definition(technical_name: str, rule_type: str, columns: str, value: str, vmin: str,
                         vmax: str, value_set: str, expression: str, data_type: str, query: str,
                         merge_columns: str) -> Column:
    """The rule parameters of one validation row as a JSON object string, from
    the named columns; assembled as ONE SQL expression (one parse instead of
    hundreds of Column calls). Only parameters given in the sheet appear; an
    unknown rule gives '{}'."""
    q = {k: f"`{v}`" for k, v in dict(tn=technical_name, rt=rule_type, cols=columns, val=value, vmin=vmin,
                                      vmax=vmax, vset=value_set, expr=expression, query=query,
                                      merge=merge_columns).items()}

    def comma(x):
        return f"filter(transform(split({x}, ','), t -> trim(t)), t -> t != '')"

    def nonempty(arr):
        return f"CASE WHEN size({arr}) > 0 THEN {arr} END"

    def nonblank(x):
        return f"CASE WHEN {x} != '' THEN {x} END"

    def frag(key, v):
        return f"CASE WHEN ({v}) IS NOT NULL THEN trim(BOTH '{{}}' FROM to_json(named_struct({_sql_str(key)}, {v}))) END"

    def num_or_text(key, x):
        num = f"try_cast({x} AS DOUBLE)"
        return f"CASE WHEN {x} = '' THEN NULL WHEN {num} IS NOT NULL THEN {frag(key, num)} ELSE {frag(key, x)} END"

    def obj(*fragments):
        return "concat('{', concat_ws(',', " + ", ".join(fragments) + "), '}')"

    tn = f"trim({q['tn']})"
    cols = comma(q["cols"])
    first_col = f"try_element_at({cols}, 1)"
    col_list = nonempty(cols)
    whole_col = nonblank(f"trim({q['cols']})")
    allowed = nonempty(comma(q["vset"]))
    merge = nonempty(comma(q["merge"]))
    val, expr = nonblank(q["val"]), nonblank(q["expr"])

    def isin(*names):
        return f"{tn} IN (" + ", ".join(_sql_str(n) for n in names) + ")"

    branches = [
        (isin("is_not_null", "is_not_empty", "is_not_null_and_not_empty", "is_not_in_future"),
         obj(frag("column", first_col))),
        (isin("is_unique"), obj(frag("columns", col_list))),
        (isin("is_in_list", "is_not_null_and_is_in_list"), obj(frag("column", whole_col), frag("allowed", allowed))),
        (isin("regex_match"), obj(frag("column", whole_col), frag("regex", val))),
        (isin("is_equal_to", "is_not_equal_to"), obj(frag("column", whole_col), frag("value", val))),
        (isin("is_valid_date"), obj(frag("column", whole_col), frag("date_format", val))),
        (isin("is_valid_timestamp"), obj(frag("column", whole_col), frag("timestamp_format", val))),
        (isin("is_in_range", "is_not_in_range"),
         obj(frag("column", whole_col), num_or_text("min_limit", q["vmin"]), num_or_text("max_limit", q["vmax"]))),
        (isin("is_not_less_than"), obj(frag("column", whole_col), num_or_text("limit", q["vmin"]))),
        (isin("is_not_greater_than"), obj(frag("column", whole_col), num_or_text("limit", q["vmax"]))),
        (isin("sql_expression"), obj(frag("expression", expr))),
        (isin("sql_query"), obj(frag("query", nonblank(q["query"])), frag("merge_columns", merge))),
        (isin("is_aggr_not_greater_than", "is_aggr_not_less_than", "is_aggr_equal", "is_aggr_not_equal"),
         obj(frag("column", first_col), frag("aggr_type", expr), num_or_text("limit", q["val"]))),
        (isin("foreign_key", "compare_datasets"),
         obj(frag("columns", col_list), frag("ref_columns", merge), frag("ref_table", val), frag("row_filter", expr))),
        (isin("has_valid_schema"), obj(frag("expected_schema", nonblank(q["cols"])))),
    ]
    builtin = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " ELSE '{}' END"
    rt = f"upper(trim({q['rt']}))"
    return F.expr(f"CASE WHEN {rt} = 'BUILT-IN' THEN {builtin} "
                  f"WHEN {rt} = 'CUSTOM' THEN {obj(frag('columns', col_list))} ELSE '{{}}' END")


# Parameters each built-in rule needs; "a|b" = at least one of.
REQUIRED_PARAMS = {
    "is_not_null": ["column"],
    "is_not_empty": ["column"],
    "is_not_null_and_not_empty": ["column"],
    "is_not_in_future": ["column"],
    "is_in_list": ["column", "allowed"],
    "is_not_null_and_is_in_list": ["column", "allowed"],
    "regex_match": ["column", "regex"],
    "is_equal_to": ["column", "value"],
    "is_not_equal_to": ["column", "value"],
    "is_valid_date": ["column"],
    "is_valid_timestamp": ["column"],
    "is_in_range": ["column", "min_limit|max_limit"],
    "is_not_in_range": ["column", "min_limit|max_limit"],
    "is_not_less_than": ["column", "limit"],
    "is_not_greater_than": ["column", "limit"],
    "sql_expression": ["expression"],
    "is_unique": ["columns"],
    "sql_query": ["query", "merge_columns"],
    "is_aggr_not_greater_than": ["limit"],
    "is_aggr_not_less_than": ["limit"],
    "is_aggr_equal": ["limit"],
    "is_aggr_not_equal": ["limit"],
    "foreign_key": ["columns", "ref_table"],
    "has_valid_schema": ["expected_schema"],
    "compare_datasets": ["columns", "ref_table"],
}


# Declared data types a sheet may name, by what is parsed.
DECLARED_TYPES = {
    "number": ["number", "int", "integer", "bigint", "long", "float", "double", "decimal"],
    "date": ["date"],
    "timestamp": ["timestamp", "datetime"],
}
_SPARK_TYPE = {"number": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP"}


def parsed_fields(technical_name: str, columns: str, value: str, vmin: str, vmax: str, value_set: str, expression: str,
                  data_type: str, merge_columns: str) -> Column:
    """The outcome of parsing each field of a built-in rule that has a type or a
    set of allowed values: array<struct<field, text, error>>, error NULL where
    the text is usable. A value is held against the declared data type, an
    aggregate against the known ones, lists and limits against each other."""
    name = F.trim(F.col(technical_name))
    kind = F.lower(F.trim(F.col(data_type)))
    empty = F.lit(None).cast("array<struct<field:string,text:string,error:string>>")

    def outcome(field: str, text: Column, error: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), text.alias("text"), error.cast("string").alias("error"))

    def typed(field: str, text: Column) -> Column:
        wrong = F.lit(None).cast("string")
        for what, names in DECLARED_TYPES.items():
            unread = kind.isin(*names) & (text != "") & text.try_cast(_SPARK_TYPE[what]).isNull()
            wrong = F.when(unread, F.concat(F.lit(field + " '"), text, F.lit(f"' is not a {what}"))).otherwise(wrong)
        return outcome(field, text, wrong)

    low, high = F.col(vmin), F.col(vmax)
    crossed = low.try_cast("double") > high.try_cast("double")
    order = outcome("min_limit", low, F.when(crossed, F.lit("min_limit above max_limit")))
    aggregate = F.lower(F.trim(F.col(expression)))
    known = outcome("aggr_type", aggregate, F.when((aggregate != "") & ~aggregate.isin(*AGGREGATES),
                                                   F.concat(F.lit("unknown aggr_type '"), aggregate, F.lit("'"))))
    own, ref = comma_list(F.col(columns)), comma_list(F.col(merge_columns))
    paired = outcome("ref_columns", F.col(merge_columns), F.when((F.size(ref) > 0) & (F.size(ref) != F.size(own)),
                                                                 F.lit("columns and ref_columns differ in length")))
    allowed = F.transform(comma_list(F.col(value_set)), lambda x: typed("allowed", x))
    by_rule = [
        (["is_in_range", "is_not_in_range"], F.array(typed("min_limit", low), typed("max_limit", high), order)),
        (["is_not_less_than"], F.array(typed("limit", low))),
        (["is_not_greater_than"], F.array(typed("limit", high))),
        (["is_equal_to", "is_not_equal_to"], F.array(typed("value", F.col(value)))),
        (["is_aggr_not_greater_than", "is_aggr_not_less_than", "is_aggr_equal", "is_aggr_not_equal"], F.array(known, typed("limit", F.col(value)))),
        (["is_in_list", "is_not_null_and_is_in_list"], allowed),
        (["foreign_key", "compare_datasets"], F.array(paired)),
    ]
    out = empty
    for names, fields in by_rule:
        out = F.when(name.isin(*names), fields).otherwise(out)
    return out


def definition_error(technical_name: str, rule_type: str, definition: Column, parsed: Column) -> Column:
    """What makes a validation of a known rule unusable, '; '-joined, or NULL:
    missing parameters and the errors of its parsed fields. Unknown rules and
    rule types have no parameters; ``definition_problems`` reports them."""
    name, kind = F.trim(F.col(technical_name)), F.upper(F.trim(F.col(rule_type)))
    missing = F.transform(absent_params(name, F.from_json(definition, "map<string,string>")), lambda g: F.concat(F.lit("missing "), g))
    wrong = F.filter(F.transform(parsed, lambda p: p["error"]), lambda e: e.isNotNull())
    none = F.array().cast("array<string>")
    errors = (F.when(kind == "BUILT-IN", F.concat(F.coalesce(missing, none), F.coalesce(wrong, none)))
              .when((kind == "CUSTOM") & F.try_element_at(F.from_json(definition, "map<string,string>"), F.lit("columns")).isNull(),
                    F.array(F.lit("missing columns")))
              .otherwise(none))
    return F.nullif(F.array_join(errors, "; "), F.lit(""))


def absent_params(name: Column, given: Column) -> Column:
    """The parameter groups that the built-in rule ``name`` needs and ``given``
    (a map) has none of."""
    needs = F.create_map(*[x for rule, groups in REQUIRED_PARAMS.items()
                           for x in (F.lit(rule), F.array(*[F.lit(g) for g in groups]))])
    return F.filter(F.try_element_at(needs, name), lambda group: ~F.coalesce(
        F.exists(F.split(group, "[|]"), lambda key: F.try_element_at(given, key).isNotNull()), F.lit(False)))


def shape_tables(sheet: DataFrame) -> DataFrame:
    s = _rename(sheet, TABLES_HEADERS)
    require_columns(s, list(TABLES_HEADERS.values()), "tables")
    return conform(s.filter(F.col("table_id") != ""), TABLES_SCHEMA)


def shape_rules(sheet: DataFrame) -> DataFrame:
    s = _rename(sheet, RULES_HEADERS)
    require_columns(s, list(RULES_HEADERS.values()), "rules")
    out = s.filter(F.col("rule_id") != "").select(
        "rule_id", "technical_rule_name", "functional_name", "description", "rule_level",
        "dimension_dq", "implementation_type",
        F.col("requires_literal_conversion").try_cast(BooleanType()).alias("requires_literal_conversion"),
        split_tags("tags").alias("tags"), "type_rule", "owner",
        F.current_timestamp().alias("updated_at"), "updated_by")
    return conform(out, RULES_SCHEMA)


def shape_validations(sheet: DataFrame) -> DataFrame:
    s = _rename(sheet, VALIDATIONS_HEADERS)
    require_columns(s, list(VALIDATIONS_HEADERS.values()), "validations")
    c = F.col
    s = s.filter(c("validation_id") != "")
    s = s.withColumn("_definition", build_definition(
        "technical_name", "rule_type", "param_columns", "param_value", "param_min", "param_max", "param_set",
        "param_expression", "param_data_type", "param_query", "param_merge_columns"))
    s = s.withColumn("_parsed", parsed_fields("technical_name", "param_columns", "param_value", "param_min", "param_max", "param_set",
                                              "param_expression", "param_data_type", "param_merge_columns"))
    out = s.select(
        "validation_id", "rule_id", "table_id",
        c("perimeter_definition"),
        # a blank or unreadable flag is NULL, i.e. inactive
        c("is_active").try_cast(BooleanType()).alias("is_active"),
        "severity",
        c("_definition").alias("validation_definition"),
        "owner", split_tags("tags").alias("tags"), F.current_timestamp().alias("updated_at"),
        "updated_by", c("table_domain").alias("domain"),
        split_tags("param_columns").alias("Param_columns"),
        c("param_value").alias("Param_value"), c("param_min").alias("Param_value_min"),
        c("param_max").alias("Param_value_max"), c("param_set").alias("Param_range"),
        c("param_data_type").alias("Param_data_type"), c("param_expression").alias("Param_expression"),
        c("param_query").alias("Param_query_SQL"), c("param_merge_columns").alias("Param_merge_columns"),
        definition_error("technical_name", "rule_type", c("_definition"), c("_parsed")).alias("definition_error"))
    return conform(out, VALIDATIONS_SCHEMA)


SHAPERS = {"tables": (shape_tables, "table_id"),
           "rules": (shape_rules, "rule_id"),
           "validations": (shape_validations, "validation_id")}


class DuplicateKeyError(ValueError):
    pass


def sync_sheet(kind: str, sheet: DataFrame | None, current: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(new contents, change report) for one sheet, or (None, None) when the
    sheet has no row with an id (nothing is synced, nothing deleted)."""
    if sheet is None:
        return None, None
    shape, key = SHAPERS[kind]
    shaped = shape(sheet)
    # config sheets are small: counting them on the driver is cheap
    stats = shaped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k")).first()
    if stats["n"] == 0:
        return None, None
    if stats["n"] != stats["k"]:
        raise DuplicateKeyError(f"sheet '{kind}' repeats ids in '{key}'")
    audit = tuple(c for c in ("updated_at",) if c in shaped.columns)
    return reflect(current, shaped, [key], audit)


def sync_config(store, tables: DataFrame | None = None, rules: DataFrame | None = None,
                validations: DataFrame | None = None) -> dict[str, list]:
    """Sync the three sheets into the config tables of ``store`` in order
    (tables, rules, validations). Returns the change report per sheet."""
    from tessera.sources.ledger_store import RULES, TABLES, VALIDATIONS
    report = {}
    for kind, sheet, name in (("tables", tables, TABLES), ("rules", rules, RULES),
                              ("validations", validations, VALIDATIONS)):
        new, changes = sync_sheet(kind, sheet, store.read(name))
        if new is None:
            continue
        # config-sized; the contents hold old rows of the table they replace
        rows = new.collect()
        report[kind] = changes.filter("action <> 'UNCHANGED'").collect()
        store.replace(name, store.spark.createDataFrame(rows, new.schema))
    return report


def active_validations(validations: DataFrame, table_id: str, severity: str | None = None,
                       validation_id: str | None = None) -> DataFrame:
    """Active validations of a table, optionally one severity / one id."""
    conds = [F.col("table_id") == table_id, F.coalesce(F.col("is_active"), F.lit(False))]
    if severity:
        conds.append(F.col("severity") == severity)
    if validation_id:
        conds.append(F.col("validation_id") == validation_id)
    return validations.filter(reduce(lambda a, b: a & b, conds))


def validation_plan(validations: DataFrame, rules: DataFrame) -> DataFrame:
    """Validations joined with their rule (name, level, implementation).

    No broadcast hint: AQE broadcasts the rule library when its measured
    size is under the threshold and shuffles otherwise."""
    lib = rules.select("rule_id", "technical_rule_name", "rule_level", "implementation_type",
                       "requires_literal_conversion")

    return validations.join(lib, "rule_id", "left")


def definition_problems(plan: DataFrame) -> DataFrame:
    """Config errors of validations joined with their rule (see
    ``validation_plan``): unknown rule id, unknown built-in rule, missing
    parameters. One row (validation_id, problem) per faulty validation; each
    definition is parsed once, and the rules' needs are one literal map."""
    name = F.col("technical_rule_name")
    impl = F.upper(F.trim(F.coalesce(F.col("implementation_type"), F.lit(""))))
    given = F.from_json(F.coalesce(F.col("validation_definition"), F.lit("{}")), "map<string,string>")
    absent = absent_params(name, F.col("_given"))
    problem = (F.when(name.isNull(), F.lit("unknown rule id"))
               .when((impl == "CUSTOM") & F.try_element_at(F.col("_given"), F.lit("columns")).isNull(), F.lit("missing columns"))
               .when((impl == "BUILT-IN") & ~name.isin(*REQUIRED_PARAMS), F.lit("unknown rule"))
               .when(impl == "BUILT-IN", F.array_join(F.transform(absent, lambda group: F.concat(F.lit("missing "), group)), "; "))
               .when(impl == "CUSTOM", F.lit(""))
               .otherwise(F.lit("unknown implementation type")))
    return (plan.withColumn("_given", given).select("validation_id", problem.alias("problem")).filter(F.col("problem") != ""))
