"""wardline: clinical-cohort analytics expressed as lazy Spark DataFrame operators.

Every public function maps DataFrame(s) to a DataFrame and triggers no action, except
where noted (size checks of broadcast sides, model fitting).
"""

__version__ = "0.1.0"
