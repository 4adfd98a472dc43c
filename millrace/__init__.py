"""millrace: PySpark operators for conversational-memory analytics and text-dataset preparation."""
