"""XML Schema 1.0 and 1.1: compiling schemas on the driver, validating node tables on the executors."""
