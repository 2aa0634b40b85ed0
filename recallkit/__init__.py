"""Long-term conversational memory as set-oriented Spark queries."""
