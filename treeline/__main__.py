from treeline.cli import main

main()
