from quern.plans import assistant, catalogue, curation, indexed, intake, knowledge  # noqa: F401  (the others add their queries to the catalogue)
