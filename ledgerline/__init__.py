"""Business analytics on Spark: profiles, KPI packs, period analyses and reports as DataFrame plans."""
