"""KPI root-cause analytics as Spark DataFrame programs."""
