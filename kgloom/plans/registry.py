"""Every query on the given tables, with its SQL."""

from kgloom.plans import context, core, extraction, lineage, mentions, more, repair, resolution, texts

QUERIES = {**core.QUERIES, **more.QUERIES, **extraction.QUERIES, **texts.QUERIES, **repair.QUERIES, **resolution.QUERIES, **context.QUERIES, **lineage.QUERIES, **mentions.QUERIES}
ORACLE_SQL = {**core.ORACLE_SQL, **more.ORACLE_SQL, **extraction.ORACLE_SQL, **texts.ORACLE_SQL, **repair.ORACLE_SQL, **resolution.ORACLE_SQL, **context.ORACLE_SQL, **lineage.ORACLE_SQL, **mentions.ORACLE_SQL}
