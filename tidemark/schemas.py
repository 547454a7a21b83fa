"""Schemas of the stored tables; every scan declares one, nothing is inferred."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


def _struct(text: str) -> T.StructType:
    """Fields from "name type, name type"; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


COMMIT_PARENTS = _struct("COMMIT string, TIMESTAMP string, PARENT string")
REVISIONS = _struct("BRANCH int, POSITION int, COMMIT_ID string, TIMESTAMP string")
BUGFIX_REVISIONS = _struct(
    "COMMIT_ID string, FIX boolean, FIX_KEYWORDS string, FILE string, COMMIT_TYPE string, LINE_START int, LINE_END int, TIMESTAMP string"
)
SNAPSHOTS = _struct("SNAPSHOT_INDEX int, SNAPSHOT_DATE date, START_COMMIT_HASH string")
SNAPSHOT_COMMITS = _struct("SNAPSHOT_INDEX int, COMMIT_HASH string")
ALL_FUNCTIONS = _struct("SNAPSHOT_DATE date, FUNCTION_SIGNATURE string, FILE string, FUNCTION_LOC int")
STATIC_METRICS = _struct("FILE string, FUNCTION_SIGNATURE string, LOC int, LOAC int, LOFC int, NOFL int, NOFC_Dup int, NOFC_NonDup int, NONEST int, NONEG int")
CHANGE_HUNKS = _struct(
    "FUNCTION_SIGNATURE string, FILE string, FUNCTION_GROSS_LOC int, COMMIT_ID string, HUNK int, LINE_DELTA int, LINES_DELETED int, "
    "LINES_ADDED int, MOD_TYPE string, NEW_FUNCTION_SIGNATURE string, NEW_FILE string, PREVIOUS_REVISION_ID string"
)
JOINT_DATA = _struct(
    "SNAPSHOT_DATE date, SNAPSHOT_INDEX int, FUNCTION_UID int, FUNCTION_SIGNATURE string, FILE string, AGE int, LAST_EDIT int, COMMITS int, "
    "LINES_CHANGED int, LINES_ADDED int, LINES_DELETED int, PREVIOUS_COMMITS int, PREVIOUS_LINES_CHANGED int, LOC int, LOAC int, LOFC int, "
    "FL int, FC_Dup int, FC_NonDup int, CND int, NEG int"
)
CORRELATED_FILES = _struct("FILENAME string, AB_COUNT int, AF_COUNT int, LF_COUNT int, ANY_SMELL_COUNT int, FIX_COUNT int, CHANGE_COUNT int, SLOC int")
LARGE_FEATURES = _struct("FILE_NAME string, FEAT_LG_SCORE double, FEAT_NAME string, FEAT_LOC int, FEAT_OCCURRENCES int, FEAT_FILES int")
