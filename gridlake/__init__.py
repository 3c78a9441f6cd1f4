"""gridlake: document-table analytics expressed as PySpark DataFrame jobs."""
