from strata.cli import main

main()
