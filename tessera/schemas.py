"""Fixed schemas of the configuration and ledger tables."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _s(name, dtype, nullable=True):
    return StructField(name, dtype, nullable)


S = StringType()

TABLES_SCHEMA = StructType([
    _s("table_id", S, False),
    _s("table_name", S, False),
    _s("table_name_tech", S, False),
    _s("domain", S),
    _s("primary_key", S, False),          # one column or a comma list
    _s("staging_evidences_table", S, False),
])

RULES_SCHEMA = StructType([
    _s("rule_id", S, False),
    _s("technical_rule_name", S, False),
    _s("functional_name", S),
    _s("description", S),
    _s("rule_level", S),                  # ROW | DATASET
    _s("dimension_dq", S),
    _s("implementation_type", S),         # BUILT-IN | CUSTOM
    _s("requires_literal_conversion", BooleanType()),
    _s("tags", ArrayType(S)),
    _s("type_rule", S),
    _s("owner", S),
    _s("updated_at", TimestampType()),
    _s("updated_by", S),
])

VALIDATIONS_SCHEMA = StructType([
    _s("validation_id", S, False),
    _s("rule_id", S, False),
    _s("table_id", S, False),
    _s("perimeter_definition", S),
    _s("is_active", BooleanType()),
    _s("severity", S),
    _s("validation_definition", S, False),  # JSON object of rule parameters
    _s("owner", S),
    _s("tags", ArrayType(S)),
    _s("updated_at", TimestampType()),
    _s("updated_by", S),
    _s("domain", S),
    _s("Param_columns", ArrayType(S)),
    _s("Param_value", S),
    _s("Param_value_min", S),
    _s("Param_value_max", S),
    _s("Param_range", S),
    _s("Param_data_type", S),
    _s("Param_expression", S),
    _s("Param_query_SQL", S),
    _s("Param_merge_columns", S),
    _s("definition_error", S),            # why the parameters cannot be used; NULL: they can
])

EXECUTIONS_SCHEMA = StructType([
    _s("execution_id", S, False),
    _s("table_id", S, False),
    _s("execution_timestamp", TimestampType()),
    _s("execution_date", DateType()),
    _s("status", S),
    _s("duration_seconds", DecimalType(10, 2)),
    _s("validations_executed", IntegerType()),
    _s("validations_failed", IntegerType()),
    _s("validations_errors", IntegerType()),
])

RESULTS_SCHEMA = StructType([
    _s("validation_trace_id", S, False),
    _s("execution_id", S, False),
    _s("validation_id", S, False),
    _s("rule_id", S, False),
    _s("status", S),                      # PASSED | FAILED | ERROR
    _s("perimeter", LongType()),
    _s("failed_records_count", LongType()),
    _s("persistent_failures", LongType()),
    _s("new_failures", LongType()),
    _s("resolved_failures", LongType()),
    _s("execution_date", DateType()),
])

EVIDENCE_SCHEMA = StructType([
    _s("evidence_id", S, False),
    _s("execution_id", S, False),
    _s("validation_id", S, False),
    _s("failed_value", S),
    _s("table_pk", S),
    _s("is_new_failure", BooleanType()),
    _s("execution_date", DateType()),
])

# START and END of a table's validation within an execution
EVENTS_SCHEMA = StructType([
    _s("execution_id", S, False),
    _s("table_id", S, False),
    _s("event", S, False),                # START | END
    _s("event_timestamp", TimestampType()),
    _s("status", S),                      # of the END: SKIPPED | SUCCESS | FAILED | ERROR
    _s("execution_date", DateType()),
])

LEDGER_SCHEMAS = {
    "dq_execution_traceability": EXECUTIONS_SCHEMA,
    "dq_validations_traceability": RESULTS_SCHEMA,
    "dq_evidences": EVIDENCE_SCHEMA,
    "dq_execution_events": EVENTS_SCHEMA,
}

CONFIG_SCHEMAS = {
    "dq_tables_config": TABLES_SCHEMA,
    "dq_rules_library": RULES_SCHEMA,
    "dq_validations_catalog": VALIDATIONS_SCHEMA,
}

# evidence identity used by dedup and by the new/persistent/resolved diff
EVIDENCE_KEY = ["validation_id", "table_pk", "failed_value"]
