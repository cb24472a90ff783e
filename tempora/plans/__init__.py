"""Query building: FLWOR pipelines, their text form, plans, and the query catalogue."""
