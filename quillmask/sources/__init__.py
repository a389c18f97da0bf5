"""Sources and sinks: Word documents, JSON files, tables of texts, audit artefacts."""
