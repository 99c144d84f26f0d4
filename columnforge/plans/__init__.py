"""Types, schemas and the catalogue façade: everything known before a plan runs."""
