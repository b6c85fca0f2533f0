"""caseweave: discovery of data-aware DECLARE models from event logs, as Spark jobs."""
