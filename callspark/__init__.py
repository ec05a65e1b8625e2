"""callspark: contact-centre and corpus analytics as PySpark DataFrame operators."""
