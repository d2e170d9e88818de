"""augury: prediction-consensus analytics and corpus preparation on PySpark."""
