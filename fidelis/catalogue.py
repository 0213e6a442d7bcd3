"""Registered queries of the audit engine and the SQL they are held against."""

from fidelis.plans import audit, chat, judged, screens, trial

QUERIES = {**trial.QUERIES, **chat.QUERIES, **audit.QUERIES, **screens.QUERIES, **judged.QUERIES}
ORACLE_SQL = {**trial.ORACLE_SQL, **chat.ORACLE_SQL, **audit.ORACLE_SQL, **screens.ORACLE_SQL, **judged.ORACLE_SQL}
