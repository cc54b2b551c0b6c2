"""Reading configuration files, archives and requested paths."""
